"""Tagged binary files read by section: only the sections that are asked for leave the disk."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from waxwing.sources.plugins import listed, opened, register

#: Fixed values of the format: the file's first bytes, bytes of a section's own head, and the beat grid's tag, head and
#: entry.
MAGIC, SECTION_HEAD = b"PMAI", 12
GRID, GRID_HEAD, BEAT = "PQTZ", 24, 8
#: Files that one task reads.
FILES = 64
#: The conf that lets filters reach a Python source.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class TaggedSections(DataSource):
    """``spark.read.format("tagged_sections").load(folder)``: a row for each section of each file.

    Rows are (path, tag, at, size, body, bytes_read, error). Section heads are walked by offset; the body of a section is read
    only if its tag is among those of the option ``tags`` (all, if there is none) or of a pushed filter, and sections of other
    tags give no rows; a file without any that is asked for gives one row without tag. ``bytes_read`` is what the file has cost until then. What follows a length that can't be is
    left, and gives a row with ``error``, as does a file of another kind or one that can't be opened.
    """

    @classmethod
    def name(cls) -> str:
        return "tagged_sections"

    def schema(self) -> str:
        return "path string, tag string, at long, size long, body binary, bytes_read long, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_Pushed if self.options.get("pushed") == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.endings = tuple(x.lower() for x in options.get("endings", "").split(",") if x)
        self.tags = {x for x in options.get("tags", "").split(",") if x} or None

    def partitions(self) -> Sequence[Files]:
        found = [x for x in listed(self.path) if not self.endings or x[0].lower().endswith(self.endings)]
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, size in part.paths:
            try:
                with system.open_input_file(path) as stream:
                    yield from self._sections(stream, path, size)
            except OSError as error:
                yield path, None, None, None, None, None, str(error)

    def _sections(self, stream, path: str, size: int) -> Iterator[tuple]:
        head = stream.read(8)
        spent = len(head)
        if head[:4] != MAGIC or len(head) < 8:
            yield path, None, 0, None, None, spent, "not a tagged file"
            return
        at = struct.unpack(">I", head[4:])[0]
        if not 8 <= at <= size:
            yield path, None, 0, None, None, spent, f"a header of {at} bytes"
            return
        none = True
        while at + SECTION_HEAD <= size:
            stream.seek(at)
            name, _, length = struct.unpack(">4sII", stream.read(SECTION_HEAD))
            tag, spent = name.decode("latin-1"), spent + SECTION_HEAD
            if length < SECTION_HEAD or at + length > size:
                yield path, tag, at, length, None, spent, f"a section of {length} bytes"
                return
            if self.tags is None or tag in self.tags:
                stream.seek(at)
                body = stream.read(length)
                spent += length
                yield path, tag, at, length, body, spent, None
                none = False
            at += length
        if none:
            yield path, None, None, None, None, spent, None


class _Pushed(_Reader):
    """The same, with equality and membership of tags taken from the query's filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("tag",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tags = values if self.tags is None else self.tags & values
            # Error rows have a tag too, so the filter is evaluated again.
            yield f


def read_sections(spark: SparkSession, path: str, tags: Sequence[str] = (), endings: Sequence[str] = ()) -> DataFrame:
    """The sections of some tags, or of all. Where the session lets filters reach Python sources, those on ``tag`` prune
    as well."""
    register(spark, TaggedSections)
    pushed = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("tagged_sections").options(tags=",".join(tags), endings=",".join(endings), pushed=pushed).load(path)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def beats(bodies: pd.Series) -> pd.Series:
    """Beat times in seconds, ascending, of grid sections; entries that a section can't hold are left."""

    def times(body: bytes | None) -> list[float] | None:
        if body is None or len(body) < GRID_HEAD:
            return None
        count = min(struct.unpack_from(">I", body, 20)[0], (len(body) - GRID_HEAD) // BEAT)
        at = np.frombuffer(body, ">u4", 2 * count, GRID_HEAD)[1::2]
        return (np.sort(at) / 1000.0).tolist()

    return pd.Series([times(b) for b in bodies], dtype=object)


def read_beats(spark: SparkSession, path: str, endings: Sequence[str] = (".dat",)) -> DataFrame:
    """(path, beats, error): the beats of each file's first grid section that holds one. A file without has an empty list,
    one that can't be read an error, beside the grid that came before what can't be."""
    found = read_sections(spark, path, [GRID], endings).withColumn("beats", F.when(F.col("error").isNull(), beats("body")))
    first = F.min_by("beats", F.when(F.col("beats").isNotNull(), F.col("at")))
    told = found.groupBy("path").agg(first.alias("beats"), F.max("error").alias("error"))
    none = F.when(F.col("error").isNull(), F.array().cast("array<double>"))
    return told.select("path", F.coalesce("beats", none).alias("beats"), "error")
