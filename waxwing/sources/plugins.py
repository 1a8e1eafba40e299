"""Sources by name: Python data sources that are registered with a session, and how their failures are told."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
SPLIT = 1 << 25


class SourceError(Exception):
    """What a source can fail with; ``kind`` names it in rows."""

    kind = "source"


class NotRegistered(SourceError):
    """No source has the name that was asked for."""

    kind = "unknown"


class TransportError(SourceError):
    """A page could not be fetched."""

    kind = "transport"


class QuotaExceeded(SourceError):
    """The source refused, as too much was asked of it."""

    kind = "quota"


class ParseError(SourceError):
    """A page that came is not of the source's form."""

    kind = "parse"


_SOURCES: dict[str, type[DataSource]] = {}


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Make a data source known under its own name, in place of one that had it."""
    spark.dataSource.register(source)
    _SOURCES[source.name()] = source


def registered() -> list[str]:
    """The names of all registered sources, sorted."""
    return sorted(_SOURCES)


def source(name: str) -> type[DataSource]:
    if name not in _SOURCES:
        raise NotRegistered(name)
    return _SOURCES[name]


def scan(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """The rows of a registered source; an unknown name fails here, not in a task."""
    source(name)
    return spark.read.format(name).options(**options).load()


@dataclass
class Split(InputPartition):
    """Some bytes of a file."""

    path: str
    start: int
    end: int


def opened(uri: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def listed(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder and those below it but for hidden ones; nothing is read."""
    system, path = opened(uri)
    one = system.get_file_info(path)
    if one.type == files.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [one] if one.type == files.FileType.File else system.get_file_info(files.FileSelector(path, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == files.FileType.File and not x.base_name.startswith(("_", ".")))


def lines(raw: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range of bytes."""
    stream = io.BufferedReader(raw, 1 << 20)
    stream.seek(max(start - 1, 0))
    # The line that the range begins in belongs to the range before, unless it begins here.
    at = start + len(stream.readline()) - 1 if start else 0
    while at < end and (line := stream.readline()):
        yield at, line
        at += len(line)


def records(page: bytes) -> Iterator[dict]:
    """The records of one response: a list, or an object with ``collection``; fails by what is wrong with it."""
    try:
        body = json.loads(page)
    except ValueError as error:
        raise ParseError(str(error)) from None
    if isinstance(body, dict) and isinstance(body.get("error"), dict):
        code = body["error"].get("code")
        raise (QuotaExceeded if code == 429 else TransportError)(f"{code}: {body['error'].get('message', '')}")
    rows = body.get("collection") if isinstance(body, dict) else body
    if not isinstance(rows, list):
        raise ParseError("no list of records")
    yield from (r for r in rows if r is not None)


def _record(row: dict) -> tuple | None:
    """(id, title, artist, duration) of a record; None for one without id, or a deleted one."""
    if not isinstance(row, dict):
        raise ParseError("a record that is no object")
    user = row.get("user") if isinstance(row.get("user"), dict) else {}
    if row.get("id") is None or (row.get("title") is None and user.get("username") is None):
        return None
    try:
        return int(row["id"]), str(row.get("title") or ""), str(user.get("username") or ""), int(row.get("duration") or 0)
    except (TypeError, ValueError) as error:
        raise ParseError(str(error)) from None


class SavedPages(DataSource):
    """Pages of a REST source as they came, one response a line: ``spark.read.format("saved_pages").load(folder)``.

    Rows are (id, title, artist, duration_ms, error); a response that is an error or can't be read gives one row with
    ``error`` (kind, message, place) and nulls, and the others go on. With the option ``mode`` = ``FAILFAST`` it fails the
    job. Files are read by ranges of ``split`` bytes; a task holds one line.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "id long, title string, artist string, duration_ms long, error struct<kind: string, message: string, place: string>"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options.get("path"), int(options.get("split", SPLIT))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        if not self.path:
            raise ValueError("saved_pages needs a path")

    def partitions(self) -> Sequence[Split]:
        return [Split(path, at, min(at + self.split, size)) for path, size in listed(self.path) for at in range(0, size, self.split)] or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator[tuple]:
        if not part.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as stream:
            for at, line in lines(stream, part.start, part.end):
                if not line.strip():
                    continue
                try:
                    # A page counts as a whole or not at all.
                    yield from [(*row, None) for row in map(_record, records(line)) if row]
                except SourceError as error:
                    if self.strict:
                        raise
                    yield None, None, None, None, (error.kind, str(error), f"{part.path}:{at}")
