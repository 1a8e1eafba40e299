"""Append-only logs seen as stores: upserts, lifecycles, time to live and undo are views over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.operators.joins import first_per


def upserted(log: DataFrame, key: str, order: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (), filled: Sequence[str] = ()) -> DataFrame:
    """One row for each key: of ``first`` columns the earliest event's value, of ``last`` the latest's, of ``filled`` the
    latest that is not null."""
    at = F.struct(*order)
    aggs = [F.min_by(c, at).alias(c) for c in first] + [F.max_by(c, at).alias(c) for c in last]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in filled]
    return log.groupBy(key).agg(*aggs)


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key, whole."""
    return first_per(log, keys, [F.desc(c) for c in order])


def stale(rows: DataFrame, fetched: str, now: float, ttl: float) -> DataFrame:
    """Rows fetched before ``now`` - ``ttl``, oldest first by the caller's order."""
    return rows.filter(F.col(fetched) < now - ttl)


def changes(log: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Events whose state differs from the one before of their key."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    return log.withColumn("_before", before).filter(~F.col(state).eqNullSafe(F.col("_before"))).drop("_before")


def stable_files(reads: DataFrame, path: str, order: Sequence[str], size: str, tries: int = 6) -> DataFrame:
    """(path, read): the first read with the size of the one before, above 0, within ``tries`` reads; others are rejected."""
    ordered = W.partitionBy(path).orderBy(*order)
    rows = reads.withColumns({"_read": F.row_number().over(ordered), "_before": F.lag(size).over(ordered)})
    same = (F.col("_read") <= tries) & (F.col(size) > 0) & (F.col(size) == F.col("_before"))
    return rows.filter(same).groupBy(path).agg(F.min("_read").alias("read"))


def cache_hits(files: DataFrame, cache: DataFrame, version: int, slack: float = 1.0) -> DataFrame:
    """``files`` (path, size, mtime) with ``hit``: whether the cache has the version, size and time, within ``slack``."""
    known = cache.select("path", F.col("version").alias("_version"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    fits = (F.col("_version") == version) & (F.col("_size") == F.col("size")) & (F.abs(F.col("_mtime") - F.col("mtime")) <= slack)
    return files.join(known, "path", "left").withColumn("hit", F.coalesce(fits, F.lit(False))).drop("_version", "_size", "_mtime")


def reverted(log: DataFrame, run: str, keys: Sequence[str], order: str, before: str) -> DataFrame:
    """(keys, value) after a run is undone: of each field the value before its first mutation that isn't undone yet."""
    own = log.filter((F.col("run_id") == run) & ~F.coalesce("reverted", F.lit(False)))
    return own.groupBy(*keys).agg(F.min_by(before, order).alias("value"))


def updated(base: DataFrame, update: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``base`` with the update's values where it has them; rows that it doesn't name stay as they are."""
    side = update.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(side, base[key] == side["_key"], "left")
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
    return joined.select(*map(value, base.columns))


def merged_memberships(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """``entries`` (pid, track_id, pos) with duplicate tracks (track_id, keeper) replaced, each once in a playlist."""
    moved = entries.join(replaced, "track_id", "left").select("pid", F.coalesce("keeper", "track_id").alias("track_id"), "pos")
    return moved.groupBy("pid", "track_id").agg(F.min("pos").alias("pos"))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, events): events of a key no more than the gap apart are one, as with a debounce timer."""
    grouped = events.groupBy(key, F.session_window(at, gap).alias("_w")).agg(F.count("*").alias("events"), F.min(at).alias("start"), F.max(at).alias("end"))
    return grouped.select(key, "start", "end", "events")


def running(df: DataFrame, order: Sequence[str], group: str, states: dict[str, Column]) -> DataFrame:
    """Counts so far of each state within the group, row by row."""
    so_far = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(state.cast("long")).over(so_far) for name, state in states.items()})


#: The kinds of taste vectors.
VECTOR_KINDS = ("centroid", "cluster_0", "cluster_1", "cluster_2")


def taste_vectors(log: DataFrame, order: Sequence[str], kinds: Sequence[str] = VECTOR_KINDS) -> DataFrame:
    """The last vector of each (profile_id, kind); unknown kinds and empty profiles go."""
    return latest(log.filter(F.col("kind").isin(*kinds) & (F.coalesce("profile_id", F.lit("")) != "")), ["profile_id", "kind"], order)


def manifests(files: DataFrame) -> DataFrame:
    """(filename, path, timestamp, target, tracks, scope_kind, batch_id) of rows (path, text) that are manifests in JSON.

    Names are manifest-*.json; what is no JSON object goes.
    """
    schema = "timestamp string, target string, tracks array<string>, scope struct<kind:string>, batch_id string"
    named = files.withColumn("filename", F.substring_index("path", "/", -1)).filter(F.col("filename").rlike(r"^manifest-.*\.json$"))
    read = named.withColumn("m", F.from_json("text", schema)).filter(F.get_json_object("text", "$").startswith("{") & F.col("m").isNotNull())
    return read.select("filename", "path", "m.timestamp", "m.target", F.coalesce(F.size("m.tracks"), F.lit(0)).cast("long").alias("tracks"), F.col("m.scope.kind").alias("scope_kind"), "m.batch_id")
