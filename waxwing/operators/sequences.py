"""Operators over ordered sequences: grids, runs, thinning, change points, resampling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)


def phrase_cues(beats: DataFrame, group: str, order: Sequence[str], length: int = 16) -> DataFrame:
    """(group, order columns, type, label, index): each ``length``-th beat starts a phrase, each other 4th a bar.

    ``length`` must be a positive multiple of 4; else there are no cues.
    """
    valid = isinstance(length, int) and length > 0 and length % 4 == 0
    rows = numbered(beats, group, order).filter(F.lit(valid) & (F.pmod("n", F.lit(4)) == 0))
    kind = F.when(F.pmod("n", F.lit(max(length, 1))) == 0, "phrase_start").otherwise("bar_start")
    rows = rows.withColumn("type", kind).withColumn("index", F.row_number().over(W.partitionBy(group, "type").orderBy("n")))
    label = F.concat(F.when(F.col("type") == "phrase_start", "P").otherwise("B"), F.col("index").cast("string"))
    return rows.select(group, *order, "type", label.alias("label"), "index")


def grid_cues(beats: DataFrame, group: str, order: Sequence[str], downbeat: Column, bars: int, most: int) -> DataFrame:
    """Every ``bars`` bars from the first downbeat, or the first beat where there is none, at most ``most`` a group."""
    rows = numbered(beats.withColumn("_down", F.coalesce(downbeat, F.lit(False))), group, order)
    anchor = F.coalesce(F.min(F.when(F.col("_down"), F.col("n"))).over(W.partitionBy(group)), F.lit(0))
    rows = rows.withColumn("_from", F.col("n") - anchor).filter((F.col("_from") >= 0) & (F.col("_from") % (bars * 4) == 0))
    rows = rows.withColumn("number", (F.col("_from") / (bars * 4)).cast("int")).filter(F.col("number") < most)
    return rows.select(group, *order, "number")


def beat_number(n: Column, downbeat: Column) -> Column:
    """1 to 4 by the distance to the downbeat, before it too."""
    return F.pmod(n - downbeat, F.lit(4)) + 1


def classified(phrases: DataFrame, group: str, order: str, energy: str, change: str) -> DataFrame:
    """``phrases`` with label and change threshold from the group's percentiles of energy and of timbre change.

    The first phrase is Intro, the last Outro; then Drop, Chorus, Bridge, Up and Verse, the first that fits.
    """
    own, ordered = W.partitionBy(group), W.partitionBy(group).orderBy(order)
    at = lambda c, p: F.percentile(c, F.lit(p)).over(own)
    rows = phrases.withColumns({"_n": F.row_number().over(ordered), "_last": F.count("*").over(own), "_before": F.lag(energy).over(ordered), "p80": at(energy, 0.8), "p50": at(energy, 0.5), "p20": at(energy, 0.2)})
    rows = rows.withColumn("_later", F.when(F.col("_n") > 1, F.col(change)))
    rows = rows.withColumn("_bar", F.coalesce(at("_later", 0.75), F.lit(0.0)))
    jump = F.col(energy) - F.col("_before")
    drop = (jump > 0.3) & (F.col(change) > F.col("_bar")) & (F.col("_before") < F.col("p50"))
    label = F.when(F.col("_n") == 1, "Intro").when(F.col("_n") == F.col("_last"), "Outro").when(drop, "Drop").when(F.col(energy) >= F.col("p80"), "Chorus")
    label = label.when(F.col(energy) <= F.col("p20"), "Bridge").when((jump > 0.15) & (F.col(change) > F.col("_bar") * 0.7), "Up").otherwise("Verse")
    return rows.withColumn("label", label).drop("_n", "_last", "_before", "_later", "_bar", "p80", "p50", "p20")


def merged_runs(df: DataFrame, group: str, order: Sequence[str], label: str, value: str, most: int) -> DataFrame:
    """Consecutive rows of one label as one, at most ``most`` rows each: (group, run, label, rows, value).

    ``value`` is averaged pair by pair in order, each mean rounded to 3 places, as a running merge does.
    """
    ordered = W.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_new", F.coalesce((F.col(label) != F.lag(label).over(ordered)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(ordered))
    rows = rows.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(group, "_run").orderBy(*order)) - 1) / most))
    item = F.struct(*order, F.col(value).cast("double").alias("_v"))
    runs = rows.groupBy(group, "_run", "_part", label).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.min(F.struct(*order)).alias("_at"))
    mean = F.aggregate(F.slice("_items", 2, F.greatest(F.size("_items"), F.lit(1))), F.element_at("_items", 1)["_v"], lambda s, x: F.round((s + x["_v"]) / 2.0, 3))
    number = F.row_number().over(W.partitionBy(group).orderBy("_at")) - 1
    return runs.select(group, number.alias("run"), label, F.size("_items").alias("rows"), mean.alias(value))


def top_cues(df: DataFrame, group: str, order: str, score: Column, most: int) -> DataFrame:
    """The first row of each group and the ``most`` - 1 others of the highest scores, numbered in order."""
    ordered = W.partitionBy(group).orderBy(order)
    rows = df.withColumn("_score", score).withColumn("_first", F.row_number().over(ordered) == 1)
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("_first"), F.desc("_score"), order))).filter(F.col("_rank") <= most)
    return rows.withColumn("number", F.row_number().over(ordered) - 1).drop("_score", "_first", "_rank")


def thinned(df: DataFrame, group: str, at: str, always: str, gap: float, most: int) -> DataFrame:
    """Rows in time order that are always kept or at least ``gap`` after the last kept one, ``most`` a group.

    What is kept depends on what was kept before: a fold over each group's rows in order, which stays in the JVM.
    """
    others = [c for c in df.columns if c not in (at, group)]
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(at, *others))).alias("rows"))
    none = F.struct(F.lit(float("-inf")).alias("last"), F.slice("rows", 1, 0).alias("kept"))
    fits = lambda acc, x: (F.size(acc["kept"]) < most) & (F.coalesce(x[always], F.lit(False)) | (x[at].cast("double") - acc["last"] >= gap))
    step = lambda acc, x: F.when(fits(acc, x), F.struct(x[at].cast("double").alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = lists.select(group, F.explode(F.aggregate("rows", none, step, lambda acc: acc["kept"])).alias("r"))
    return kept.select(*(F.col(group) if c == group else F.col(f"r.{c}").alias(c) for c in df.columns))


def change_points(df: DataFrame, group: str, at: str, value: str, change: float, spacing: float, steady: float) -> DataFrame:
    """(group, at, value) anchors of a curve: its first point, then each that is ``change`` or more from the last anchor
    and ``spacing`` or more after it. A curve whose deviation is below ``steady`` has one."""
    point = F.struct(F.col(at).cast("double").alias("at"), F.col(value).cast("double").alias("value"))
    curves = df.groupBy(group).agg(F.array_sort(F.collect_list(point)).alias("points"), F.stddev_pop(F.col(value).cast("double")).alias("deviation"))
    # The fold carries the last anchor and those found; it stays in the JVM, one curve at a time.
    first = F.get("points", F.lit(0))
    far = lambda last, x: (F.abs(x["value"] - last["value"]) >= change) & (x["at"] - last["at"] >= spacing)
    step = lambda acc, x: F.when(far(acc["last"], x), F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = F.aggregate(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.struct(first.alias("last"), F.array(first).alias("kept")), step, lambda acc: acc["kept"])
    anchors = curves.select(group, F.explode(F.when(F.col("deviation") >= steady, kept).otherwise(F.array(first))).alias("p"))
    return anchors.select(group, F.col("p.at").alias(at), F.col("p.value").alias(value))


def matched_within(reference: Iterable[float], found: Iterable[float], tolerance: float) -> list[tuple[float, float]]:
    """Each reference time with the nearest unused found one within the tolerance, in time order."""
    pairs, used, rest = [], set(), sorted(found)
    for t in sorted(reference):
        near = [(abs(x - t), i) for i, x in enumerate(rest) if i not in used and abs(x - t) <= tolerance]
        if near:
            _, i = min(near)
            used.add(i)
            pairs.append((t, rest[i]))
    return pairs


def matched_pairs(df: DataFrame, group: str, at: str, ours: str, tolerance: float) -> DataFrame:
    """(group, reference, found) of one-to-one matches: each of the other times in order takes the nearest of ours within
    the tolerance that is left, the earlier one on a tie. Rows without time go; null counts as the other's; a null
    group matches nothing.

    Times meet by bins of twice the tolerance, so that rounding can't part them. A choice depends on those before it only as far as times lie within the
    tolerance of each other, so a group is cut wherever there is a wider gap, and each piece is folded in order in the JVM.
    """
    line = W.partitionBy(group).orderBy("t", "o", "i")
    rows = df.select(F.col(group), F.col(at).cast("double").alias("t"), F.coalesce(F.col(ours), F.lit(False)).alias("o")).filter(F.col("t").isNotNull())
    # Equal times are told apart by their number.
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy(group, "o").orderBy("t")))
    cut = F.coalesce(F.col("t") - F.lag("t").over(line) > tolerance, F.lit(True)).cast("long")
    rows = rows.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(line)).drop("cut").withColumn("bin", F.floor(F.col("t") / (2 * tolerance or 1.0)))
    others, mine = rows.filter(~F.col("o")), rows.filter("o")
    near = others.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    mine = mine.select(F.col(group), "bin", F.col("t").alias("u"), F.col("i").alias("j"))
    gap = F.abs(F.col("u") - F.col("t"))
    choices = near.join(mine, [group, "bin"]).filter(gap <= tolerance).groupBy(group, "piece", "t", "i")
    choices = choices.agg(F.array_sort(F.collect_list(F.struct(gap.alias("gap"), "j", "u"))).alias("near"))
    pieces = choices.groupBy(group, "piece").agg(F.array_sort(F.collect_list(F.struct("t", "i", "near"))).alias("rows"))
    none = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<reference: double, found: double>>").alias("pairs"))

    def step(acc: Column, row: Column) -> Column:
        best = F.get(F.filter(row["near"], lambda x: ~F.array_contains(acc["used"], x["j"])), F.lit(0))
        pair = F.struct(row["t"].alias("reference"), best["u"].alias("found"))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(best["j"])).alias("used"), F.concat(acc["pairs"], F.array(pair)).alias("pairs")))

    return pieces.select(group, F.explode(F.aggregate("rows", none, step, lambda acc: acc["pairs"])).alias("p")).select(group, "p.reference", "p.found")


def match_scores(df: DataFrame, group: str, at: str, ours: str, tolerance: float) -> DataFrame:
    """(group, f_measure, median_error) of our times against the others, each used once; the error is null without a match."""
    total = df.filter(F.col(at).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    pairs = matched_pairs(df, group, at, ours, tolerance).withColumnRenamed(group, f"{group}_matched")
    found = pairs.groupBy(f"{group}_matched").agg(F.count("*").alias("m"), F.median(F.abs(F.col("found") - F.col("reference"))).alias("median_error"))
    both = total.join(found, total[group].eqNullSafe(found[f"{group}_matched"]), "left")
    return both.select(group, (F.lit(2.0) * F.coalesce("m", F.lit(0)) / F.col("n")).alias("f_measure"), "median_error")


def local_peak(df: DataFrame, group: str, order: Sequence[str], value: str, reach: int = 2) -> Column:
    """The largest value within ``reach`` rows over the group's largest, to 3 places."""
    near = W.partitionBy(group).orderBy(*order).rowsBetween(-reach, reach)
    return F.round(F.max(value).over(near) / F.max(value).over(W.partitionBy(group)), 3)


def rms_bins(df: DataFrame, group: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """(group, bin, rms) of full bins of ``width`` rows; what is left over goes."""
    rows = numbered(df, group, order)
    bins = rows.groupBy(group, F.floor(F.col("n") / width).alias("bin")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("rows"))
    return bins.filter(F.col("rows") == width).drop("rows")
