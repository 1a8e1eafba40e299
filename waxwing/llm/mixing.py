"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import private

#: Sources in order of their names take these weights in turn.
WEIGHTS = (5, 2, 1)
#: The mix's share of all words, and the most of a source's words and of a document's that it takes.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    """Runs of bytes other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> those, weight and target, over one row for each source.

    A source's cap is ``most`` times its size. Filling all sources in proportion to weight, they reach their caps in the
    order of cap / weight; the level at the first that stays below its cap gives the targets of all from there on.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1))
    table = table.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("order", F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))
    before, all_ = W.orderBy("order").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    table = table.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(all_)
    return table.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared).alias("target"))


def mixture(docs: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies, the times that the mix takes the row.

    ``size`` names a long column. A source's documents each expect target / size copies. They are ordered by size class
    and a hash of the id, their expected copies summed up, and a random offset below 1 (of the seed and source) added;
    a row is taken once for each integer that its own share crosses. So the words that a source gives are near its target
    at any size, and no row is taken more often than ``most``, rounded up.

    The prefix sum is in two steps: counts of (source, size class, hash salt) and their running totals, then the order
    within each of those, which stay small for a source of any size. Null is a source of its own, last; null sizes
    count as 0, and a source without words has target 0. Repeated rows count one by one; rows of one id and size are
    ordered by a hash of all columns. An empty table gives none. Columns named like those added are replaced.
    """
    docs = docs.drop(*(c for c in ("_source_size", "_target", "_copies") if c not in (size, source, doc_id)))
    name, key, kind, salt, digest, tied, before, rank = private(docs, "name", "key", "class", "salt", "digest", "tied", "before", "rank")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"_size": F.coalesce(F.col(size).cast("long"), F.lit(0)), name: F.col(source).cast("string"), tied: F.xxhash64(*hashed)})
    # The length in binary, then the next three digits: classes of about a tenth of their size.
    size_class = F.expr("CASE WHEN _size > 0 THEN length(bin(_size)) * 8 + shiftright(_size * 8, length(bin(_size)) - 1) ELSE 0 END").cast("long")
    rows = rows.withColumns({key: F.coalesce(F.concat(F.lit("s"), name), F.lit("n")), kind: size_class, digest: F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))})
    rows = rows.withColumn(salt, F.substring(digest, 1, 3))
    cells = rows.groupBy(key, name, kind, salt).agg(F.count("*").alias("n"), F.sum("_size").alias("words"))
    sources = targets(cells.groupBy(F.col(name).alias("source")).agg(F.sum("words").alias("source_size")), weights, share, most)
    sources = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias(key), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    running = F.sum("n").over(W.partitionBy(key).orderBy(kind, salt)) - F.col("n")
    placed = rows.join(cells.select(key, kind, salt, running.alias(before)).join(sources, key), [key, kind, salt])
    place = F.col(before) + F.row_number().over(W.partitionBy(key, kind, salt).orderBy("_size", digest, tied))
    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    copies = F.floor(F.col(rank) * expected + offset) - F.floor((F.col(rank) - 1) * expected + offset)
    out = placed.withColumn(rank, place).withColumn("_copies", F.least(copies, F.ceil(F.lit(most))).cast("long"))
    return out.drop(name, key, kind, salt, digest, tied, before, rank)


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of a ``mixture`` as often as taken, without its columns."""
    (copy,) = private(mixed, "copy")
    out = mixed.filter("_copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.drop("_size", "_source_size", "_target", "_copies", copy)


#: The rows of the query op2 in DuckDB.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
t1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM t0),
t2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS o FROM t1),
t3 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lv FROM t2),
t4 AS (SELECT *, CASE WHEN cap / w <= lv THEN cap ELSE w * (max(CASE WHEN cap / w > lv THEN lv END) OVER ()) END AS target FROM t3),
r AS (SELECT d.*, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS h, CASE WHEN size > 0 THEN length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) ELSE 0 END AS c FROM d),
k AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY c, substr(h, 1, 3), size, h) AS rk FROM r),
m AS (SELECT k.doc_id, k.size, t4.source_size, t4.target, rk, CASE WHEN t4.source_size > 0 THEN t4.target / t4.source_size ELSE 0.0::DOUBLE END AS e,
    ('0x' || substr(md5('mix-1:' || coalesce('s' || k.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM k JOIN t4 ON k.source IS NOT DISTINCT FROM t4.source)
SELECT doc_id, size, source_size, target, (size * least(floor(rk * e + u) - floor((rk - 1) * e + u), 2))::BIGINT AS taken FROM m
"""
