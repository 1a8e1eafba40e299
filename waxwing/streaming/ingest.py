"""Incremental ingest with Structured Streaming: folder source, debounce, in-flight dedup, status lifecycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def watched(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder and those below it, as a stream."""
    return spark.readStream.format(form).schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def debounced(events: DataFrame, key: str, at: str, gap: str = "2.5 seconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a key's events, once nothing more came for the gap: (key, start, end, events)."""
    bursts = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key)).agg(F.count("*").alias("events"), F.max(at).alias("end"))
    return bursts.select(key, F.col("w.start").alias("start"), "end", "events")


def fresh(events: DataFrame, known: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events whose key the catalogue lacks, each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]).join(known.select(key).distinct(), key, "left_anti")


def _lifecycle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a key's latest event and how often its status changed; events may come in any order within a batch."""
    at, status, changes = state.get if state.exists else (-1, None, 0)
    rows = pd.concat(list(frames)).sort_values(["at", "status"])
    for t, s in zip(rows["at"], rows["status"], strict=True):
        if t >= at:
            changes += s != status
            at, status = int(t), s
    state.update((at, status, int(changes)))
    yield pd.DataFrame({"key": [key[0]], "status": [status], "at": [at], "changes": [int(changes)]})


def lifecycle(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """The latest status of each key after each batch: (key, status, at, changes). ``at`` is a whole number."""
    plain = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(status).cast("string").alias("status"))
    shape = "key string, status string, at long, changes long"
    return plain.groupBy("key").applyInPandasWithState(_lifecycle, shape, "at long, status string, changes long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a table in memory; for tests and backfills of small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
