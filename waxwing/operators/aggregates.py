"""Grouped counts, histograms, representatives and canonical picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.operators.staging import numbered_in_order

from waxwing.operators.joins import first_per


def ranked_counts(names: DataFrame, name: str, prefix: str, least: int = 1) -> DataFrame:
    """(id, name, count) of each name; ids number all names in order, those below ``least`` included, which then go."""
    counts = names.filter(F.col(name) != "").groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count"))
    ranked = numbered_in_order(counts, ["name"], "rank")
    return ranked.withColumn("id", F.concat(F.lit(prefix), (F.col("rank") - 1).cast("string"))).filter(F.col("count") >= least).select("id", "name", "count")


def first_where(value: str, order: str, keep: Column) -> Column:
    """The value of the first row in the order for which ``keep`` holds."""
    return F.min_by(F.when(keep, F.col(value)), F.when(keep, F.col(order)))


def duplicate_groups(tracks: DataFrame) -> DataFrame:
    """Tracks of equal title and artist whatever the case, two or more: the first one's spelling, ids and count."""
    groups = tracks.groupBy(F.lower("title").alias("t"), F.lower("artist").alias("a"))
    found = groups.agg(F.min_by("title", "id").alias("title"), F.min_by("artist", "id").alias("artist"), F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return found.filter("n > 1").select("title", "artist", "ids", "n")


def dense_histogram(values: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(value, n) for every integer from low to high, zeros included; other values are ignored."""
    keyed = values.select(F.col(value).try_cast("int").alias("value")).filter(F.col("value").between(low, high))
    counts = keyed.groupBy("value").agg(F.count("*").alias("n"))
    every = values.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("value"))
    return every.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bins(value: Column, width: float) -> Column:
    return F.floor(value / width) * width


def shares(df: DataFrame, column: str, top: int) -> DataFrame:
    """(name, n, pct) of the most frequent names; blanks are Unknown, the share is of all rows, rounded half up."""
    named = df.select(F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "Unknown").otherwise(F.col(column)).alias("name"))
    counts = named.groupBy("name").agg(F.count("*").alias("n"))
    total = F.broadcast(named.agg(F.count("*").alias("total")))  # one row
    pct = F.floor(F.col("n") * 100.0 / F.col("total") + 0.5).cast("long")
    return counts.join(total).select("name", "n", pct.alias("pct")).orderBy(F.desc("n"), "name").limit(top)


def best_of(df: DataFrame, group: str, score: Column, order: str) -> DataFrame:
    """The row of the highest score of each group, the first on a tie."""
    return first_per(df.withColumn("score", score), [group], [F.desc("score"), order])


def canonical(tracks: DataFrame) -> DataFrame:
    """The canonical track of each root: (root, canonical_id, score).

    ``tracks`` has id, root, label, year, stem and pinned. A pinned track wins, the least id of several. Else a track
    scores 0.3 if untagged or original, 0.2 if of the root's earliest year, 0.1 if of its shortest stem; ties go to the
    least id.
    """
    own = W.partitionBy("root")
    score = (
        F.when(F.coalesce("label", F.lit("original")) == "original", 0.3).otherwise(0.0)
        + F.when(F.col("year") == F.min("year").over(own), 0.2).otherwise(0.0)
        + F.when(F.length("stem") == F.min(F.length("stem")).over(own), 0.1).otherwise(0.0)
    )
    scored = tracks.withColumn("score", F.when(F.coalesce("pinned", F.lit(False)), 1.0).otherwise(F.round(score, 3)))
    return first_per(scored, ["root"], [F.desc("score"), "id"]).select("root", F.col("id").alias("canonical_id"), "score")


def variant_edges(tracks: DataFrame) -> DataFrame:
    """(track_id, parent_id, root, confidence) from each track to its root's canonical one, in roots of two or more:
    0.75 for the same artist, else 0.55."""
    pick = canonical(tracks).select("root", "canonical_id")
    heads = tracks.select(F.col("id").alias("canonical_id"), F.lower("artist").alias("_artist"))
    sure = F.when(F.lower("artist") == F.col("_artist"), 0.75).otherwise(0.55)
    joined = tracks.join(pick, "root").filter("id <> canonical_id").join(heads, "canonical_id")
    return joined.select(F.col("id").alias("track_id"), F.col("canonical_id").alias("parent_id"), "root", sure.alias("confidence"))
