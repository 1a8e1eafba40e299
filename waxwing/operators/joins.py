"""Star, bridge, reconcile, diff and nearest joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str, name: str, alias: str) -> DataFrame:
    """``facts`` with the dimension's name as ``alias``; a miss gives an empty text."""
    side = dimension.select(F.col(dimension_key).alias("_key"), F.col(name).alias(alias))
    return facts.join(side, facts[key] == side["_key"], "left").drop("_key").withColumn(alias, F.coalesce(alias, F.lit("")))


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def playlist_tracks(entries: DataFrame, tracks: DataFrame, once: bool = False) -> DataFrame:
    """Tracks of each playlist in entry order; dangling ids go. ``once`` keeps a track's first entry of a playlist."""
    kept = first_per(entries, ["pid", "track_id"], ["pos"]) if once else entries
    return kept.join(tracks.withColumnRenamed("id", "track_id"), "track_id")


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], order: Sequence[str], alias: str) -> DataFrame:
    """``parents`` with an array of their children's fields in order; orphans go, childless parents get an empty array."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    lists = children.groupBy(F.col(child_key).alias("_key")).agg(F.array_sort(F.collect_list(item)).alias(alias))
    out = parents.join(lists, parents[key] == lists["_key"], "left").drop("_key")
    shaped = F.transform(alias, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return out.withColumn(alias, F.coalesce(shaped, F.array().cast(out.select(shaped).schema[0].dataType)))


def reconcile(left: DataFrame, right: DataFrame, last_sync: float) -> DataFrame:
    """Play counts of two sides (track_id, play_count, last_played) against the last sync: equal, conflict, pc or usb.

    Only ids on both sides come back; of an id's right rows the last in (last_played, play_count) counts. A side has
    changed if it played after the sync, or, before any sync, at all.
    """
    newest = first_per(right.filter(F.col("track_id").isNotNull()), ["track_id"], [F.desc("last_played"), F.desc("play_count")])
    side = lambda df, x: df.select("track_id", F.coalesce("play_count", F.lit(0)).cast("long").alias(f"{x}_count"), F.coalesce("last_played", F.lit(0.0)).alias(f"{x}_last_played"))
    both = side(left, "pc").join(side(newest, "usb"), "track_id")
    changed = lambda x: F.col(f"{x}_last_played") > last_sync if last_sync > 0 else F.col(f"{x}_count") > 0
    same = F.col("pc_count") == F.col("usb_count")
    source = F.when(same, "equal").when(changed("pc") & changed("usb"), "conflict").when(changed("pc"), "pc").otherwise("usb")
    both = both.withColumn("source", source)
    pick = lambda what, top: F.when(F.col("source") == "conflict", None).when(F.col("source") == "equal", top).when(F.col("source") == "pc", F.col(f"pc_{what}")).otherwise(F.col(f"usb_{what}"))
    return both.withColumns({"resolved_count": pick("count", F.col("pc_count")), "resolved_last_played": pick("last_played", F.greatest("pc_last_played", "usb_last_played"))})


def resolved(strategy: str) -> Column:
    """A conflict's count by a strategy; an unknown one takes the larger."""
    pc, usb = F.col("pc_count"), F.col("usb_count")
    return {"take_pc": pc, "take_usb": usb, "sum": pc + usb}.get(strategy, F.greatest(pc, usb))


def row_hash(*columns: str) -> Column:
    """A row's md5 over its columns as text; null counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def added(new: DataFrame, old: DataFrame, key: str = "hash") -> DataFrame:
    """Different keys of ``new`` that ``old`` lacks."""
    return new.dropDuplicates([key]).join(old.select(key).distinct(), key, "left_anti")


def merged_by(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Upsert on a key: the update's values where it has them, else the base's; with _source, both, base or update."""
    a, b = base.select(*(F.col(c).alias(f"_a_{c}") for c in base.columns)), update.select(*(F.col(c).alias(f"_b_{c}") for c in update.columns))
    both = a.join(b, F.col(f"_a_{key}") == F.col(f"_b_{key}"), "full")
    value = lambda c: F.coalesce(*(F.col(f"_{s}_{c}") for s, cols in (("b", update.columns), ("a", base.columns)) if c in cols)).alias(c)
    columns = [*base.columns, *(c for c in update.columns if c not in base.columns)]
    source = F.when(F.col(f"_a_{key}").isNull(), "update").when(F.col(f"_b_{key}").isNull(), "base").otherwise("both")
    return both.select(*map(value, columns), source.alias("_source"))


def nearest(left: DataFrame, right: DataFrame, group: str, at: str, other: str) -> DataFrame:
    """For each left row the nearest right time of its group, the later one on a tie: (left columns, nearest, gap).

    An as-of join in both directions: one sort of both sides by group and time, the last right time up to a row and the
    first from it on, so nothing is multiplied. Groups without right times have null.
    """
    marks = right.select(F.col(group).alias("_g"), F.col(other).alias("_t"), F.col(other).alias("_mark")).filter("_t is not null")
    rows = left.select(F.col(group).alias("_g"), F.col(at).alias("_t"), F.lit(None).cast(dict(marks.dtypes)["_mark"]).alias("_mark"), F.struct("*").alias("_row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy("_g").orderBy("_t")
    before = F.last("_mark", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, 0))
    after = F.first("_mark", ignorenulls=True).over(order.rangeBetween(0, W.unboundedFollowing))
    both = both.withColumns({"_before": before, "_after": after}).filter("_row is not null")
    later = F.col("_before").isNull() | (F.abs(F.col("_after") - F.col("_t")) <= F.abs(F.col("_t") - F.col("_before")))
    best = F.when(F.col("_after").isNotNull() & later, F.col("_after")).otherwise(F.col("_before"))
    return both.withColumn("nearest", best).select("_row.*", "nearest", F.abs(F.col("nearest") - F.col("_t")).alias("gap"))


def snap(value: Column, marks: Column) -> Column:
    """The array element nearest to the value, the earlier one on a tie; null for an empty array."""
    return F.array_min(F.transform(marks, lambda x: F.struct(F.abs(x - value).alias("gap"), x.alias("mark"))))["mark"]


def restricted(tracks: DataFrame, selection: DataFrame, key: str = "id") -> DataFrame:
    """``tracks`` of the selection's ids; an empty selection is an error, as it would export nothing."""
    if selection.isEmpty():
        raise ValueError("the selection holds no track")
    return tracks.join(selection.select(key), key, "left_semi")


def merged_playlist(sources: DataFrame, target: DataFrame) -> DataFrame:
    """(track_id, first) to add to the target playlist: the sources' tracks (pid, track_id, pos) that it lacks, each with
    its first place."""
    wanted = sources.groupBy("track_id").agg(F.min(F.struct("pid", "pos")).alias("first"))
    return wanted.join(target.select("track_id").distinct(), "track_id", "left_anti")


def complete_sources(sources: DataFrame, merged: DataFrame) -> DataFrame:
    """(pid, complete) of each source playlist: whether the merged one holds all of its tracks, so that it may go."""
    held = merged.select("track_id").distinct().withColumn("held", F.lit(True))
    return sources.join(held, "track_id", "left").groupBy("pid").agg(F.bool_and(F.col("held").isNotNull()).alias("complete"))


def committed(both: DataFrame, strategy: str) -> DataFrame:
    """(side, track_id, play_count) to write after ``reconcile``: conflicts by the strategy, on each side only what changes."""
    count = F.when(F.col("source") == "conflict", resolved(strategy)).otherwise(F.col("resolved_count"))
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_count").alias("old")) for x in ("pc", "usb"))))
    rows = both.select("track_id", count.alias("play_count"), sides.alias("s"))
    return rows.filter(F.col("s.old") != F.col("play_count")).select("s.side", "track_id", "play_count")
