"""Edit projects: XML files of tracks with nested sections, of which each may be bad without harm to the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sections of a track: where their elements lie, and of each element the attribute, its column, its type and what
#: counts where it is absent. Fixed values of the format.
SECTIONS = {
    "volume": ("edit.volume.data.section", [("start", "start", "double", "0"), ("end", "end", "double", "0"), ("vol", "vol", "double", "1")]),
    "bpm_map": ("edit.bpm.data.section", [("start", "start", "double", "0"), ("end", "end", "double", "0"), ("bpm", "bpm", "double", "0")]),
    "hotcues": ("edit.prepared.hotcue.data.cue", [("index", "index", "int", "0"), ("name", "name", "string", ""), ("position", "position", "double", "0"), ("color", "color", "string", "")]),
    "memory_cues": ("edit.prepared.memorycue.data.cue", [("index", "index", "int", "0"), ("name", "name", "string", ""), ("position", "position", "double", "0")]),
    "active_censors": ("edit.prepared.activecensor.data.section", [("start", "start", "double", "0"), ("end", "end", "double", "0")]),
    "positions": ("edit.position.data.section", [("start", "start", "double", "0"), ("end", "end", "double", "0"), ("songstart", "song_start", "double", "0"), ("songend", "song_end", "double", "0")]),
    "beat_grid": ("songgrid.orggrid.data.beat", [("index", "index", "int", "0"), ("bpm", "bpm", "double", "0"), ("position", "position", "double", "0")]),
}


def _element(names: str) -> str:
    return f"array<struct<{', '.join(f'`_{n}`: string' for n in names.split())}>>"


def _data(kind: str, names: str) -> str:
    return f"struct<data: struct<{kind}: {_element(names)}>>"


#: All attributes are text, so that a bad one can't lose its element.
_EDIT = (
    f"struct<_VALUE: string, volume: {_data('section', 'start end vol')}, bpm: {_data('section', 'start end bpm')}, "
    f"prepared: struct<hotcue: {_data('cue', 'index name position color')}, memorycue: {_data('cue', 'index name position')}, activecensor: {_data('section', 'start end')}>, "
    f"position: {_data('section', 'start end songstart songend')}>"
)
_PLACES = "start end songstart songend"
_SONG = (
    f"struct<_id: string, _uuid: string, title: string, artist: string, album: string, filepath: string, data: struct<filepath: string>, edit: {_EDIT}, "
    f"position: struct<section: {_element(_PLACES)}, data: struct<section: {_element(_PLACES)}>>>"
)
_TRACK = f"struct<_trackid: string, song: {_SONG}, edit: {_EDIT}, songgrid: struct<_bpm: string, _length: string, orggrid: {_data('beat', 'index bpm position')}>>"
PROJECT = f"info struct<app: string, version: string>, tracks struct<track: array<{_TRACK}>>, _corrupt_record string"


def _values(elements: Column, shape: list) -> tuple[Column, Column]:
    """(elements with typed values, the first attribute that is no number) of a section; an element with a bad one goes."""
    raw = lambda x, attribute, kind, other: F.coalesce(x[f"_{attribute}"] if kind == "string" else F.nullif(F.trim(x[f"_{attribute}"]), F.lit("")), F.lit(other))
    value = lambda x, attribute, kind, other: raw(x, attribute, kind, other) if kind == "string" else raw(x, attribute, kind, other).try_cast(kind)
    typed = lambda x: F.struct(*(value(x, a, k, o).alias(c) for a, c, k, o in shape))
    bad = lambda x: F.concat(F.lit(""), *(F.when(value(x, a, k, o).isNull(), F.concat(F.lit(f"{a}="), raw(x, a, k, o), F.lit(" "))).otherwise("") for a, c, k, o in shape if k != "string"))
    there = F.coalesce(elements, F.array().cast(elements_type(shape)))
    fine = F.filter(there, lambda x: bad(x) == "")
    return F.transform(fine, typed), F.trim(F.array_join(F.transform(there, bad), ""))


def elements_type(shape: list) -> str:
    return _element(" ".join(a for a, *_ in shape))


def _at(track: Column, path: str) -> Column:
    for name in path.split("."):
        track = track[name]
    return track


def parsed(texts: DataFrame, name: str = "path", text: str = "text") -> DataFrame:
    """A row for each track of each project text: its song's columns, a list for each kind of section, and ``errors``.

    ``errors`` maps a kind of section to the attributes that are no numbers; their elements go, the rest of the section and all
    others stay. A text that is no XML, or a project without tracks, gives one row with null ``track_id``, and with the error
    ``project`` in the former case. Tracks without a song go. Newer files hold path, edits and positions in the track, older ones in the
    song; both are read.
    """
    # What is no XML gives nulls and its text, not a failure.
    read = texts.select(F.col(name).alias("path"), F.from_xml(text, PROJECT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "nullValue": "\u0000"}).alias("p"), F.col(text).alias("raw"))
    broken = F.col("raw").isNull() | F.col("p._corrupt_record").isNotNull() | F.col("p").isNull()
    songs = F.filter("p.tracks.track", lambda t: t["song"].isNotNull())
    rows = read.select("path", broken.alias("broken"), F.coalesce("p.info.app", F.lit("")).alias("app"), F.coalesce("p.info.version", F.lit("1")).alias("version"), F.explode_outer(F.when(~broken, songs)).alias("t"))
    song = F.col("t.song")
    edit = F.coalesce(F.col("t.edit"), song["edit"])
    rows = rows.withColumn("x", F.struct(edit.alias("edit"), F.col("t.songgrid").alias("songgrid")))
    columns, errors = {}, []
    for kind, (path, shape) in SECTIONS.items():
        found, wrong = _values(_at(F.col("x"), path), shape)
        if kind == "positions":
            old = F.coalesce(F.when(F.size(song["position"]["section"]) > 0, song["position"]["section"]), song["position"]["data"]["section"])
            older, wrong_too = _values(F.slice(old, 1, 1), shape)
            found, wrong = F.when(F.size(found) > 0, found).otherwise(older), F.trim(F.concat_ws(" ", wrong, F.when(F.size(found) == 0, wrong_too)))
        columns[kind] = found
        errors.append(F.when(wrong != "", F.struct(F.lit(kind).alias("key"), wrong.alias("value"))))
    errors.append(F.when(F.col("broken"), F.struct(F.lit("project").alias("key"), F.lit("no XML").alias("value"))))
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    there = F.col("t").isNotNull()
    return rows.select(
        "path",
        "app",
        "version",
        F.when(there, or_empty(F.col("t._trackid"))).alias("track_id"),
        *(F.when(there, or_empty(song[a])).alias(c) for a, c in (("_id", "song_id"), ("_uuid", "uuid"), ("title", "title"), ("artist", "artist"), ("album", "album"))),
        F.when(there, F.trim(or_empty(F.coalesce(song["filepath"], song["data"]["filepath"])))).alias("file_path"),
        *(F.when(there, c).alias(kind) for kind, c in columns.items()),
        F.when(there, F.array_max(F.transform(columns["positions"], lambda x: x["end"]))).alias("end_beats"),
        F.col("t.songgrid._bpm").try_cast("double").alias("bpm"),
        F.col("t.songgrid._length").try_cast("int").alias("grid_length"),
        F.map_from_entries(F.array_compact(F.array(*errors))).alias("errors"),
    )


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of all project files of a folder and those below it; each file is one text, as its editor writes it.
    Spark's readers skip files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rbep").load(path)
    return parsed(files.select("path", F.col("content").cast("string").alias("text")))
