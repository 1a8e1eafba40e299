"""One view of a catalogue, whichever source it comes from: canonical tracks, playlists and their entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waxwing.sources import trees
from waxwing.sources.catalog import coerced, read_tracks

#: The canonical columns of a track and their types; numbers that are none count as 0, absent texts as empty.
TRACK = {
    "id": "string",
    "title": "string",
    "artist": "string",
    "album": "string",
    "genre": "string",
    "key": "string",
    "path": "string",
    "bpm": "double",
    "rating": "int",
    "bitrate": "int",
    "play_count": "int",
    "duration_ms": "long",
}


def duration(df: DataFrame) -> Column:
    """Milliseconds from whichever of ``duration_ms``, ``total_time`` and ``length`` (seconds) a source has, the first above 0."""
    known = [coerced(F.col(c), "double") * scale for c, scale in (("duration_ms", 1), ("total_time", 1000), ("length", 1000)) if c in df.columns]
    return F.coalesce(*(F.when(x > 0, x) for x in known), F.lit(0.0)) if known else F.lit(0.0)


def canonical(df: DataFrame) -> DataFrame:
    """Any source's rows as canonical tracks; columns that it lacks are empty or 0, and garbage never fails the scan."""
    columns = {c: coerced(F.col(c), kind) if c in df.columns else coerced(F.lit(None).cast("string"), kind) for c, kind in TRACK.items() if c != "duration_ms"}
    return df.select(*(c.alias(name) for name, c in columns.items()), duration(df).cast("long").alias("duration_ms")).select(*TRACK)


@dataclass(frozen=True)
class Library:
    """``tracks`` (canonical), ``playlists`` (id, name, parent_id, type, seq) and ``entries`` (pid, pos, track_id)."""

    mode: str
    tracks: DataFrame
    playlists: DataFrame
    entries: DataFrame

    def track(self, track_id: str) -> DataFrame:
        """The track of an id: one row or none. The filter reaches the source."""
        return self.tracks.filter(F.col("id") == track_id)

    def track_ids(self, playlist: str) -> DataFrame:
        """(pos, track_id) of a playlist in order of pos; an unknown one has none."""
        return self.entries.filter(F.col("pid") == playlist).select("pos", "track_id").orderBy("pos")

    def contents(self) -> DataFrame:
        """(pid, name, pos, and the track's columns) of all entries whose track is known."""
        named = self.entries.join(self.playlists.select(F.col("id").alias("pid"), "name"), "pid")
        return named.join(self.tracks, named["track_id"] == self.tracks["id"]).drop("track_id")


_MODES: dict[str, Callable[..., Library]] = {}


def library(mode: str) -> Callable:
    """Register the decorated function as the maker of libraries of a mode, in place of an earlier one."""

    def add(make: Callable[..., Library]) -> Callable[..., Library]:
        _MODES[mode] = make
        return make

    return add


def modes() -> list[str]:
    return sorted(_MODES)


def opened(spark: SparkSession, mode: str, place: str) -> Library:
    """The library of a mode at a place; an unknown mode is a ValueError that names the known ones."""
    if mode not in _MODES:
        raise ValueError(f"no library of mode {mode!r}; known: {', '.join(modes())}")
    return _MODES[mode](spark, place)


@library("xml")
def from_xml(spark: SparkSession, place: str) -> Library:
    """A collection's XML: tracks by elements, its tree in splits."""
    nodes, entries = trees.read_tree(spark, place)
    return Library("xml", canonical(read_tracks(spark, place)), nodes.drop("rules"), entries.withColumnRenamed("track_key", "track_id"))


@library("tables")
def from_tables(spark: SparkSession, place: str) -> Library:
    """The tables of the benchmark schema seen as a catalogue."""
    from waxwing.sources import adapters

    held = adapters.entries(spark, place).select(F.concat(F.lit("o"), F.col("pid").cast("string")).alias("pid"), F.col("pos").cast("long").alias("pos"), F.col("track_id").cast("string").alias("track_id"))
    return Library("tables", canonical(adapters.tracks(spark, place)), adapters.nodes(spark, place), held)
