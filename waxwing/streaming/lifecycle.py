"""Status lifecycles: the stages that keys go through, from a table and from a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statuses that end a life, and seconds after which a key is forgotten: after such a status, and after any other.
FINISHED = ("Completed", "Failed", "Skipped")
KEEP, ABANDONED = 3600, 86400
#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STAGE = "key string, life long, nth long, stage string, at timestamp, stages array<string>"


def stages(events: DataFrame, key: str, at: str, status: str, order: Sequence[str] = (), finished: Sequence[str] = FINISHED, keep: int = KEEP, abandoned: int = ABANDONED) -> DataFrame:
    """(key, life, nth, stage, at, stages): each change of a key's status, and the stages of its life until then.

    Events go by time, then ``order``, then status; a status that repeats is no change. A key that was finished for more than
    ``keep`` seconds, or silent for more than ``abandoned``, starts a new life. Events without key, time or status go.
    """
    line = W.partitionBy("key").orderBy("us", *(f"o{i}" for i in range(len(order))), "stage")
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(status).cast("string").alias("stage"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).dropna(subset=["key", "us", "stage"])
    before, last = F.lag("us").over(line), F.lag("stage").over(line)
    limit = F.when(last.isin(*finished), keep).otherwise(abandoned).cast("long") * 1_000_000
    rows = rows.withColumn("new", before.isNull() | (F.col("us") - before > limit)).withColumn("change", F.col("new") | (last != F.col("stage")))
    rows = rows.withColumn("life", F.sum(F.col("new").cast("long")).over(line)).filter("change")
    inside = W.partitionBy("key", "life").orderBy("us", *(f"o{i}" for i in range(len(order))), "stage").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("key", "life", F.count("*").over(inside).alias("nth"), "stage", F.timestamp_micros("us").alias("at"), F.collect_list("stage").over(inside).alias("stages"))


class _Lifecycle(StatefulProcessor):
    """Holds back a key's events until the watermark passes them, so that they count in order however they came."""

    def __init__(self, finished: Sequence[str], keep: int, abandoned: int):
        self.finished, self.keep, self.abandoned = set(finished), keep, abandoned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, place string, stage string")
        self.history = handle.getListState("history", "stage string")
        self.last = handle.getValueState("last", "us long, stage string, life long")

    def _limit(self, stage: str) -> int:
        return (self.keep if stage in self.finished else self.abandoned) * 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for frame in rows for x in zip(frame["us"].tolist(), frame["place"].tolist(), frame["stage"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(x[0] for x in new) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in waiting if x[0] <= passed], [x for x in waiting if x[0] > passed]
        # A call of the state is a way to another process and back, so it is read and written once a key, not once an event.
        last = self.last.get() if self.last.exists() else None
        so_far = [x[0] for x in self.history.get()] if due and self.history.exists() else []
        out, kept = [], len(so_far)
        for us, _, stage in due:
            new = last is None or us - last[0] > self._limit(last[1])
            life = (last[2] if last else 0) + new
            if new:
                so_far, kept = [], 0
            if new or last[1] != stage:
                so_far = [*so_far, stage]
                out.append((key[0], life, len(so_far), stage, pd.Timestamp(us, unit="us"), so_far))
            last = (us, stage, life)
        if due:
            self.last.update(last)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        end = (last[0] + self._limit(last[1])) // 1000 + 1 if last else 0
        if last and not rest and end * 1000 <= passed:
            # Only the number of lives stays of a forgotten key.
            self.history.clear()
        else:
            if out and not kept:
                self.history.put([(x,) for x in so_far])
            elif len(so_far) > kept:
                self.history.appendList([(x,) for x in so_far[kept:]])
            if due:
                self.handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _STAGE.split(", ")])

    def close(self) -> None:
        pass


def tracked(events: DataFrame, key: str, at: str, status: str, order: Sequence[str] = (), late: str = "1 hour", finished: Sequence[str] = FINISHED, keep: int = KEEP, abandoned: int = ABANDONED) -> DataFrame:
    """``stages`` of a stream, in append mode: a change is told once the watermark, ``late`` behind, has passed it.

    Events of a key that come in another order within that time count in order of time. A key's state is its events that the
    watermark has not passed, the stages of its present life, and its last status; the stages are dropped by a timer when
    the life ends. Numbers in ``order`` must be whole and not negative. Needs ``STORE`` as the session's state store.
    """
    place = F.concat(F.lit(""), *(F.lpad(F.col(c).cast("string"), 20, "0") for c in order)) if order else F.lit("")
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at), F.unix_micros(F.col(at)).alias("us"), place.alias("place"), F.col(status).cast("string").alias("stage"))
    rows = rows.dropna(subset=["key", "us", "stage"])
    return rows.groupBy("key").transformWithStateInPandas(_Lifecycle(finished, keep, abandoned), _STAGE, "Append", "EventTime")


class state_store:  # noqa: N801
    """Within the block, new streams keep their state in ``STORE``."""

    def __init__(self, spark: SparkSession):
        self.conf, self.name = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.conf.get(self.name, None)
        self.conf.set(self.name, STORE)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.conf.unset(self.name)
        else:
            self.conf.set(self.name, self.before)
