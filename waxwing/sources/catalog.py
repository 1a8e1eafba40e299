"""Readers: collection XML, playlist trees, REST pages, beat grids, audio folders; and the canonical track projection."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as tree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waxwing.functions.text import decode_path

#: Attributes of a track element, and the canonical columns they fill with their types.
ATTRIBUTES = {
    "TrackID": ("id", "string"),
    "Name": ("title", "string"),
    "Artist": ("artist", "string"),
    "Album": ("album", "string"),
    "Genre": ("genre", "string"),
    "Label": ("label", "string"),
    "Tonality": ("key", "string"),
    "Comments": ("comment", "string"),
    "Remixer": ("remixer", "string"),
    "Composer": ("composer", "string"),
    "DateAdded": ("stock_date", "string"),
    "AverageBpm": ("bpm", "double"),
    "Rating": ("rating", "int"),
    "BitRate": ("bitrate", "int"),
    "PlayCount": ("play_count", "int"),
    "Year": ("release_year", "int"),
    "SampleRate": ("sample_rate", "int"),
    "TotalTime": ("total_time", "double"),
    "Colour": ("color_id", "string"),
}
#: Endings of audio files.
AUDIO = ("mp3", "wav", "flac", "aiff", "aif", "m4a", "aac", "ogg", "opus", "alac", "wma")


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(f"_{x}", T.StringType()) for x in names]


TRACK_SCHEMA = T.StructType(
    _text(*ATTRIBUTES, "Location")
    + [
        T.StructField("TEMPO", T.ArrayType(T.StructType(_text("Inizio", "Bpm", "Battito", "Battuta", "Metro")))),
        T.StructField("POSITION_MARK", T.ArrayType(T.StructType(_text("Name", "Type", "Start", "End", "Num", "Red", "Green", "Blue")))),
    ]
)


def coerced(value: Column, kind: str) -> Column:
    """A canonical value: text is never null, whole numbers are cut from decimals, garbage counts as 0."""
    if kind == "string":
        return F.coalesce(value.cast("string"), F.lit(""))
    number = value.try_cast("double")
    return F.coalesce(number.try_cast(kind), F.lit(0).cast(kind))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """The collection's tracks with beats and position marks; elements without an id (playlist references) go.

    All attributes are read as text, so a bad one can't fail the scan, and cast one by one.
    """
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(TRACK_SCHEMA).load(path).filter(F.col("_TrackID").isNotNull())
    number = lambda x, kind: x.try_cast(kind)
    beat = lambda x: F.struct(number(x["_Inizio"], "double").alias("time"), number(x["_Bpm"], "double").alias("bpm"), number(F.coalesce(x["_Battito"], x["_Battuta"]), "int").alias("beat"), x["_Metro"].alias("metro"))
    mark = lambda x: F.struct(x["_Name"].alias("name"), number(x["_Type"], "int").alias("type"), number(x["_Start"], "double").alias("start"), number(x["_End"], "double").alias("end"), number(x["_Num"], "int").alias("num"), *(number(x[f"_{c}"], "int").alias(c.lower()) for c in ("Red", "Green", "Blue")))
    return raw.select(
        *(coerced(F.col(f"_{x}"), kind).alias(name) for x, (name, kind) in ATTRIBUTES.items()),
        decode_path(F.col("_Location")).alias("path"),
        F.transform("TEMPO", beat).alias("beats"),
        F.transform("POSITION_MARK", mark).alias("position_marks"),
    )


def _walk(node: tree.Element, parent: str) -> Iterator[tuple]:
    for i, child in enumerate(node.findall("NODE")):
        key = f"{parent}_{i}_{child.get('Name', '')}"
        smart = child.find("SmartList")
        yield key, child.get("Name", ""), parent, 4 if smart is not None else int(child.get("Type") or 0), i, [x.get("Key") for x in child.findall("TRACK")], tree.tostring(smart, "unicode") if smart is not None else None
        yield from _walk(child, key)


NODE_SCHEMA = "id string, name string, parent_id string, type int, seq int, track_keys array<string>, rules string"


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """The playlist tree as flat nodes, one task for each file: (id, name, parent_id, type, seq, track_keys, rules)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    root = tree.fromstring(content).find("PLAYLISTS")
                except tree.ParseError:
                    continue
                top = root.find("NODE") if root is not None else None
                rows = list(_walk(top, "ROOT")) if top is not None else []
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in NODE_SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, NODE_SCHEMA)


def read_pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Records of REST pages saved as JSON, each a list or an object with ``collection``: (id, title, artist, duration_ms).

    Records without an id go, and deleted ones, that have neither title nor user.
    """
    record = "struct<id: long, title: string, duration: long, user: struct<username: string>>"
    lines = spark.read.text(path, wholetext=True)
    as_list = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{record}>")).otherwise(F.from_json("value", f"collection array<{record}>")["collection"])
    rows = lines.select(F.explode(as_list).alias("r")).filter("r is not null and r.id is not null and (r.title is not null or r.user.username is not null)")
    rows = rows.select("r.id", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.user.username", F.lit("")).alias("artist"), F.coalesce("r.duration", F.lit(0)).alias("duration_ms"))
    return rows if most is None else rows.limit(most)


def parse_grid(content: bytes) -> list[float]:
    """Beat times in seconds of a tagged binary file: the grid section's entries of (beat, tempo, milliseconds)."""
    if content[:4] != b"PMAI":
        raise ValueError("not a tagged file")
    at = struct.unpack_from(">I", content, 4)[0]
    while at + 12 <= len(content):
        tag, head, size = struct.unpack_from(">4sII", content, at)
        if size < 12:
            raise ValueError("a section of no length")
        if tag == b"PQTZ":
            count = struct.unpack_from(">I", content, at + 20)[0]
            return [struct.unpack_from(">HHI", content, at + head + 8 * i)[2] / 1000.0 for i in range(count)]
        at += size
    return []


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, beats, error): a file that can't be read gives its error and no beats, and the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((name, parse_grid(bytes(content)), None))
                except (ValueError, struct.error) as error:
                    rows.append((name, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "beats", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, beats array<double>, error string")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of audio files at any depth; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.filter(ending.isin(*AUDIO)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A catalogue query of a database over JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
