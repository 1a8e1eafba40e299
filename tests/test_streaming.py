"""Streams with state and callbacks against the same over tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waxwing.streaming import callbacks, ingest, lifecycle

START = datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, n long, status string"


def lives(rows, keep, abandoned, finished=lifecycle.FINISHED):
    out, last, told = [], {}, {}
    for key, at, _, status in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2], r[3])):
        before = last.get(key)
        if before is None or (at - before[0]).total_seconds() > (keep if before[1] in finished else abandoned):
            told[key] = (told.get(key, (0,))[0] + 1, [])
        elif before[1] == status:
            last[key] = (at, status)
            continue
        told[key][1].append(status)
        out.append((key, told[key][0], len(told[key][1]), status, at, list(told[key][1])))
        last[key] = (at, status)
    return sorted(out)


def events(pick, n=400):
    rows, at = [], START
    for i in range(n):
        at += timedelta(seconds=pick.choice([0, 0.25, 5, 60, 600]))
        rows.append((pick.choice("abcdef"), at, i, pick.choice(["Queued", "Analyzing", "Analyzing", "Completed", "Failed"])))
    return rows


def test_stages_of_a_table(spark):
    rows = events(random.Random(1))
    given = spark.createDataFrame(rows + [(None, START, 1, "x"), ("a", None, 1, "x"), ("a", START, 1, None)], SCHEMA)
    found = lifecycle.stages(given, "key", "at", "status", ["n"], keep=900, abandoned=2000)
    assert sorted((*r[:5], list(r[5])) for r in found.collect()) == lives(rows, 900, 2000)
    first = [("t", START, 0, "Queued"), ("t", START, 1, "Analyzing"), ("t", START, 2, "Analyzing"), ("t", START, 3, "Completed")]
    assert lifecycle.stages(spark.createDataFrame(first, SCHEMA), "key", "at", "status", ["n"]).orderBy("nth").collect()[-1].stages == ["Queued", "Analyzing", "Completed"]


@pytest.mark.parametrize("keep", [900, 5])
def test_stages_of_a_stream_equal_the_table(spark, tmp_path, keep):
    """In batches whose rows overlap in time; what the watermark has not passed at the end is held back."""
    pick = random.Random(keep)
    rows = events(pick)
    late = sorted(range(len(rows)), key=lambda i: rows[i][1] + timedelta(seconds=pick.uniform(0, 1500)))
    for part in range(8):
        some = [rows[i] for i in late[part * 50 : part * 50 + 50]]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with lifecycle.state_store(spark):
        told = ingest.run_once(lifecycle.tracked(stream, "key", "at", "status", ["n"], "30 minutes", keep=keep, abandoned=2000), f"told{keep}", f"file://{tmp_path}/check")
    found = sorted((*r[:5], list(r[5])) for r in told.collect())
    # The watermark counts whole milliseconds.
    passed = max(r[1] for r in rows) - timedelta(minutes=30)
    wanted = [x for x in lives(rows, keep, 2000) if x[4] <= passed]
    assert found == wanted and len(wanted) > 100 and max(x[1] for x in wanted) > 1


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    calls = []

    def analysed(rows):
        calls.append(rows.count())
        return rows.withColumn("bpm", F.length("path"))

    known = spark.createDataFrame([("k",)], "path string")
    importer = callbacks.Importer(spark, f"file://{tmp_path}/out", "path", "path string, size long, bpm int", analysed, lambda: known, "size")
    assert importer.imported().collect() == [] and importer.ledger().collect() == []
    one = spark.createDataFrame([("a", 3), ("a", 2), ("k", 1), ("bb", 5), (None, 1)], "path string, size long")
    two = spark.createDataFrame([("a", 9), ("ccc", 1)], "path string, size long")
    importer(one, 0)
    state = sorted(tuple(r) for r in importer.imported().collect())
    assert state == [("a", 2, 1, 0), ("bb", 5, 2, 0)]
    importer(one, 0)
    assert sorted(tuple(r) for r in importer.imported().collect()) == state and calls == [2]

    # A batch breaks after its rows and before its line in the ledger.
    analysed(two).write.parquet(f"file://{tmp_path}/out/rows/batch=1")
    assert sorted(tuple(r) for r in importer.imported().collect()) == state
    importer(two, 1)
    assert sorted(tuple(r) for r in importer.imported().collect()) == [*state, ("ccc", 1, 3, 1)]
    assert sorted((r.batch, r.rows) for r in importer.ledger().collect()) == [(0, 2), (1, 1)]


def test_callbacks_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"f{j}", j) for j in range(i, i + 3)], "path string, size long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    importer = callbacks.Importer(spark, f"file://{tmp_path}/out", "path", "path string, size long")
    for _ in range(2):
        stream = spark.readStream.schema("path string, size long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        callbacks.watched_into(stream, importer, f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.path, r.size) for r in importer.imported().collect()) == [(f"f{j}", j) for j in range(5)]


def test_a_failing_callback_leaves_nothing(spark, tmp_path):
    def broken(rows):
        raise ValueError("no analyser")

    importer = callbacks.Importer(spark, f"file://{tmp_path}/out", "path", "path string, size long", broken)
    with pytest.raises(ValueError, match="analyser"):
        importer(spark.createDataFrame([("a", 1)], "path string, size long"), 0)
    assert importer.imported().collect() == [] and importer.ledger().collect() == []


def test_state_is_read_and_written_once_a_key():
    """However many events are due, a timer asks each state a bounded number of times; what is told stays the same."""
    from waxwing.streaming.lifecycle import _Lifecycle

    calls = []

    class Held:
        def __init__(self, rows):
            self.rows = rows

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: bool(self.rows), "get": lambda: self.rows if isinstance(self.rows, (list, tuple)) else None, "update": self._set, "put": self._set, "appendList": lambda x: self._set([*self.rows, *x]), "clear": lambda: self._set([])}[name]

        def _set(self, rows):
            self.rows = rows

    class Timers:
        registerTimer = staticmethod(lambda at: calls.append("timer"))  # noqa: N815
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)  # noqa: N815

    life = _Lifecycle(("end",), 3600, 86400)
    life.handle, life.history, life.last = Timers, Held([("a",)]), Held((5, "a", 2))
    life.waiting = Held([(10**6 * i, "", "ab"[i % 2]) for i in range(1, 500)])
    told = list(life.handleExpiredTimer(("k",), Timers, None))[0]
    assert told["nth"].tolist() == list(range(2, 501)) and set(told["life"]) == {2} and told["stages"].iloc[-1] == ["a", *["ba"[i % 2] for i in range(499)]]
    assert len(calls) < 20 and life.last.rows == (499 * 10**6, "b", 2)
