"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import folder, staged

#: Random projections, the share of them in which a vector must collide with the query, the first half-width of a window
#: in units of the projections' spread, the factor by which a round widens it, and the share of a block to verify at least.
PROJECTIONS, THRESHOLD, FIRST, WIDER, VERIFIED = 96, 0.62, 0.2, 1.3, 0.2
#: Vectors and queries in a block.
BLOCK, QUERIES = 16384, 1024
SEED = 11


def projections(dims: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, count))


def search_block(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances) of about the k nearest of one block of vectors, for each query's place; nearest first,
    then by id and row. Of rows that repeat an id each counts by itself; those with the query's id are no candidates.

    Each projection's values are sorted. A query's windows start narrow about its own values and widen by rounds (virtual
    rehashing); a vector that lies in enough of the windows is a candidate. The rounds end when the candidates make
    up the share to verify and hold k others than the query, or all vectors are in. Candidates are verified exactly.
    """
    n, m = len(ids), PROJECTIONS
    base = projections(vectors.shape[1])
    values = (vectors @ base).T
    order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
    values = np.take_along_axis(values, order, axis=1)
    unit, wants = max(float(values.std()), 1e-300), (queries @ base).T
    need, enough = math.ceil(THRESHOLD * m), min(n, max(math.ceil(VERIFIED * n), 4 * (k + 1)))
    count = np.zeros((len(queries), n), np.int16)
    low = np.stack([np.searchsorted(v, w) for v, w in zip(values, wants, strict=True)])
    high, open_, width = low.copy(), np.arange(len(queries)), FIRST * unit
    while len(open_):
        lo = np.stack([np.searchsorted(v, w - width) for v, w in zip(values, wants[:, open_], strict=True)])
        hi = np.stack([np.searchsorted(v, w + width, "right") for v, w in zip(values, wants[:, open_], strict=True)])
        rest = []
        for i, q in enumerate(open_.tolist()):
            cuts = zip(order, lo[:, i].tolist(), low[:, q].tolist(), high[:, q].tolist(), hi[:, i].tolist(), strict=True)
            fresh = np.concatenate([part for o, a, b, c, d in cuts for part in (o[a:b], o[c:d])])
            count[q] += np.bincount(fresh, minlength=n).astype(np.int16)
            found = np.flatnonzero(count[q] >= need)
            if len(found) < enough and (lo[:, i].any() or (hi[:, i] < n).any()):
                rest.append(q)
                continue
            found = found[ids[found] != query_ids[q]]
            gap = np.sqrt(((vectors[found] - queries[q]) ** 2).sum(axis=1))
            if len(gap) > 4 * k:
                near = np.flatnonzero(gap <= np.partition(gap, 2 * k)[2 * k])
                found, gap = found[near], gap[near]
            best = np.lexsort((rows[found], ids[found], gap))[:k]
            yield q, found[best], gap[best]
        low[:, open_], high[:, open_] = np.minimum(lo, low[:, open_]), np.maximum(hi, high[:, open_])
        open_, width = np.array(rest, np.int64), width * WIDER


def _matrix(table: pa.Table, rows: str) -> np.ndarray:
    flat = table.column(rows).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(table.num_rows, -1)


_FOUND = "query_id long, row long, vec_id long, score double"


def _searched(k: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        ids, rows = block.column("id").to_numpy(), block.column("row").to_numpy()
        query_ids = asked.column("query_id").to_numpy()
        if len(ids) and len(query_ids):
            found = list(search_block(ids, rows, _matrix(block, "x"), query_ids, _matrix(asked, "y"), k))
        query = np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)
        place = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
        score = np.concatenate([np.zeros(0), *(x[2] for x in found)])
        columns = (query_ids[query], rows[place], ids[place], score)
        return pa.table({name.split()[0]: pa.array(x) for name, x in zip(_FOUND.split(", "), columns, strict=True)})

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, x) of the rows with an id and a vector that has components, all finite and not all zero."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest by Euclidean distance of the rows whose id ``every`` divides.

    Candidates are all rows but those with the query's own id, and each row counts, also of those that repeat an id or are
    equal; a query id that repeats asks once, by the least of its vectors. Ties go to the smaller id. Distances are exact.
    Null, zero and non-finite vectors take no part, nor do rows with a null id; vectors meet only those of as many
    components. An empty table gives no rows. Queries go in blocks to all blocks of vectors, and each pair of blocks gives
    the k best of each query: nothing else moves after that.
    """
    path = folder(vectors.sparkSession)
    rows = staged(usable(vectors, vec_id, embedding).withColumn("dims", F.size("x")).withColumn("row", F.monotonically_increasing_id()), path)
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")).withColumn("dims", F.size("x"))
    vector_blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, BLOCK), (asked, QUERIES)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = rows.select("dims", F.pmod(F.xxhash64("row"), F.lit(vector_blocks)).cast("int").alias("v"), upto(query_blocks).alias("q"), "id", "row", "x")
    asked = asked.select("dims", upto(vector_blocks).alias("v"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"), F.col("id").alias("query_id"), F.col("x").alias("y"))
    keys = ["dims", "v", "q"]
    found = blocks.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_searched(k), _FOUND)
    best = W.partitionBy("query_id").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
