"""Writers: collection XML and playlist trees."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waxwing.operators.hierarchy import paths
from waxwing.sources.catalog import ATTRIBUTES

#: Tracks of a file of XML.
RECORDS = 100_000


def grid_of(anchors: str, beats: str) -> Column:
    """The tempo anchors, or the whole grid where there are none."""
    return F.when(F.size(anchors) > 0, F.col(anchors)).otherwise(F.col(beats))


def with_drop_cue(marks: str, drop: Column) -> Column:
    """The position marks and, where the drop's time is known, one more for it."""
    cue = F.struct(F.lit("DROP").alias("name"), F.lit(0).alias("type"), drop.alias("start"), F.lit(None).cast("double").alias("end"), F.lit(-1).alias("num"), *(F.lit(v).alias(c) for c, v in (("red", 255), ("green", 0), ("blue", 0))))
    old = F.coalesce(marks, F.array().cast("array<struct<name:string,type:int,start:double,end:double,num:int,red:int,green:int,blue:int>>"))
    return F.when(drop.isNull(), old).otherwise(F.concat(old, F.array(cue)))


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks as XML elements with attributes, nested TEMPO and POSITION_MARK, in files of at most ``RECORDS`` tracks.

    A file of XML is read by one task, and a small table with many rows comes as one part, so rows are dealt out first.
    """
    text = lambda name: F.col(name).cast("string")
    attributes = [text(name).alias(f"_{x}") for x, (name, _) in ATTRIBUTES.items() if name in tracks.columns]
    location = F.concat(F.lit("file://localhost"), F.replace(F.replace(F.url_encode(F.coalesce("path", F.lit(""))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))
    beat = lambda x: F.struct(*(x[a].cast("string").alias(f"_{b}") for a, b in (("time", "Inizio"), ("bpm", "Bpm"), ("beat", "Battito"), ("metro", "Metro"))))
    mark = lambda x: F.struct(*(x[b.lower()].cast("string").alias(f"_{b}") for b in ("Name", "Type", "Start", "End", "Num", "Red", "Green", "Blue")))
    nested = []
    if "beats" in tracks.columns:
        nested.append(F.transform("beats", beat).alias("TEMPO"))
    if "position_marks" in tracks.columns:
        nested.append(F.transform("position_marks", mark).alias("POSITION_MARK"))
    elements = tracks.select(*attributes, location.alias("_Location"), *nested).hint("rebalance")
    elements.write.mode("overwrite").option("maxRecordsPerFile", RECORDS).format("xml").option("rootTag", "COLLECTION").option("rowTag", "TRACK").save(path)


def playlist_lines(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(at, line): the playlist tree and its entries (pid, track_id, pos) as lines of XML, in the order of ``at``.

    A node's opening, tracks, children by seq and id, and closing sort after each other; orphans go.
    """
    step = lambda seq: F.lpad(F.coalesce(seq, F.lit(0)).cast("string"), 12, "0")
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keyed = nodes.withColumn("key", F.concat(step(F.col("seq")), F.hex(F.col("id").cast("string"))))
    at = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("2"), x))
    placed = paths(keyed, "key").select("id", at.alias("at")).join(nodes.select("id", "name", "type"), "id")
    end = lambda *parts: F.concat("at", F.array(*parts))
    begun = placed.select(end(F.lit("0")).alias("at"), F.concat(F.lit('<NODE Type="'), F.col("type").cast("string"), F.lit('" Name="'), escaped(F.coalesce("name", F.lit(""))), F.lit('">')).alias("line"))
    closed = placed.select(end(F.lit("3")).alias("at"), F.lit("</NODE>").alias("line"))
    held = entries.join(placed, entries["pid"] == placed["id"])
    held = held.select(end(F.concat(F.lit("1"), step(F.col("pos"))), F.col("track_id").cast("string")).alias("at"), F.concat(F.lit('<TRACK Key="'), escaped(F.col("track_id")), F.lit('"/>')).alias("line"))
    frame = [(["0"], '<DJ_PLAYLISTS Version="1.0.0"><PLAYLISTS><NODE Type="0" Name="ROOT">'), (["3"], "</NODE></PLAYLISTS></DJ_PLAYLISTS>")]
    return nodes.sparkSession.createDataFrame(frame, "at array<string>, line string").unionByName(begun).unionByName(held).unionByName(closed)


def write_playlists(nodes: DataFrame, entries: DataFrame, path: str) -> None:
    """The playlist tree as XML in text files, which follow each other in the order of their names; nothing is collected."""
    playlist_lines(nodes, entries).orderBy("at").select("line").write.mode("overwrite").text(path)


class EmptySelection(ValueError):
    """A restricted export would hold no track."""


def moved(df: DataFrame, source: str, target: str) -> None:
    """Rename a written folder on the file system that it lies on; the target gives way."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    system = old.getFileSystem(conf)
    system.delete(new, True)
    if not system.rename(old, new):
        raise OSError(f"{source} could not be renamed to {target}")


def restricted_export(tracks: DataFrame, entries: DataFrame, playlists: Collection | None, path: str, write: Callable[[DataFrame, str], None] = write_tracks, key: str = "id") -> int:
    """Write the tracks of some playlists' entries (pid, track_id), of all where ``playlists`` is None, and give their number.

    The rows are counted while they are written, beside the target, and only then put in its place: playlists that hold no
    known track raise EmptySelection and leave an earlier export as it was. Nothing is read twice. A track of several
    playlists counts once; unknown playlists and entries without a track are left out.
    """
    chosen = tracks
    if playlists is not None:
        wanted = entries.filter(F.col("pid").isin(*playlists)) if playlists else entries.limit(0)
        chosen = tracks.join(wanted.select(F.col("track_id").alias(key)), key, "left_semi")
    seen = Observation(f"export-{uuid.uuid4().hex}")
    beside = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    write(chosen.observe(seen, F.count(F.lit(1)).alias("rows")), beside)
    count = int(seen.get["rows"])
    if not count and playlists is not None:
        jvm = tracks.sparkSession._jvm
        part = jvm.org.apache.hadoop.fs.Path(beside)
        part.getFileSystem(tracks.sparkSession._jsc.hadoopConfiguration()).delete(part, True)
        raise EmptySelection(f"no track in the {len(playlists)} playlists")
    moved(tracks, beside, path)
    return count
