"""Near-duplicate vectors: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.operators.components import components

from .work import folder, private, small_side, staged

#: Links need at least this cosine.
COSINE = 0.98
#: Bits of a code, tables that they are split over, and turns of the rotation's alternating fit.
BITS, TABLES, TURNS = 64, 4, 40
#: Vectors that a rotation is fitted on, and lengths of vector that get a fitted one; the others take their own coordinates.
SAMPLE, FITTED = 20_000, 8
#: A label of at most so many different vectors is one group; beyond that its tables are split by code into shards of
#: about so many owners, and a shard's visitors and owners into blocks.
WHOLE, OWNERS, VISITORS = 2_048, 8_192, 32_768
#: Classes of equal vectors are common from this share of all rows on, so there are at most as many as its inverse.
COMMON = 0.001
#: Vectors and rotations are rounded to multiples of the inverse of this, so that all machines see the same bits.
GRID = 1 << 14
#: Candidate pairs that one step of a task holds.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Rotation:
    """A centre and orthonormal directions, both in units of the grid."""

    centre: np.ndarray
    axes: np.ndarray

    def turned(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Coordinates of the normalised vectors: sums of whole numbers below 2**53, so the order of adding doesn't matter."""
        whole = np.rint(vectors / norms[:, None] * GRID) - self.centre
        return (whole @ self.axes) / (GRID * GRID)


def fitted(vectors: np.ndarray, bits: int = BITS, turns: int = TURNS, seed: int = 17) -> Rotation:
    """Iterative quantisation: principal directions of the centred vectors, then the rotation of them that brings the
    coordinates nearest to their signs, by alternating signs and an orthogonal Procrustes fit."""
    centre = np.rint(vectors.mean(axis=0) * GRID)
    x = vectors - centre / GRID
    _, directions = np.linalg.eigh(x.T @ x)
    directions = directions[:, ::-1][:, :bits]
    x = x @ directions
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((x.shape[1],) * 2))[0]
    for _ in range(turns):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
        turn = u @ v
    return Rotation(centre, np.rint(directions @ turn * GRID))


def plain(dims: int, bits: int = BITS) -> Rotation:
    return Rotation(np.zeros(dims), np.eye(dims, min(dims, bits)) * GRID)


def reach(cosine: float, dims: int) -> float:
    """The square of the largest distance of two turned unit vectors of at least this cosine, rounding included."""
    # Rounding moves a coordinate by half a grid step, and stretches a direction by as much for each of its components.
    return ((math.sqrt(2 - 2 * cosine) + 2 * math.sqrt(dims) / GRID) * (1 + dims / GRID)) ** 2


def _energy(turned: np.ndarray) -> np.ndarray:
    """Squares in steps so coarse that sums of them are exact in any order; rounded down, which only adds visits."""
    return np.floor(turned**2 * (1 << 40)) / (1 << 40)


def _parts(bits: int) -> list[slice]:
    ends = [bits * i // TABLES for i in range(TABLES + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def codes(turned: np.ndarray, part: slice) -> np.ndarray:
    signs = turned[:, part] >= 0
    return (signs.astype(np.int64) << np.arange(signs.shape[1])).sum(axis=1)


def probes(turned: np.ndarray, part: slice, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all codes of a table that a row visits: its own with any set of bits flipped whose squares sum to the
    budget at most, the empty set included."""
    energy = _energy(turned[:, part])
    rows, spent, flips = np.arange(len(turned)), np.zeros(len(turned)), np.zeros(len(turned), np.int64)
    for i in range(energy.shape[1]):
        more = spent + energy[rows, i]
        fits = more <= budget
        rows, spent, flips = np.concatenate((rows, rows[fits])), np.concatenate((spent, more[fits])), np.concatenate((flips, flips[fits] | (1 << i)))
    return rows, codes(turned, part)[rows] ^ flips


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, member) of all members of ranges."""
    size = ends - starts
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[which]


def linked(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, visits: np.ndarray, owns: np.ndarray, rotation: Rotation, tables: list[int], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places of two vectors) of at least the cosine in which the first visits the second, in bounded steps.

    If two unit vectors lie within the reach r, then over the bits in which their codes differ the squares of both
    vectors' coordinates sum to r**2 at most. So in one of the tables they sum to r**2 / TABLES at most, and to half of it for
    one of the two: that one visits the other's code. Each pair is given once: in the first such table, by the vector
    of smaller id if both may visit. So groups that see other tables or other rows of the label never give it again.
    """
    turned = rotation.turned(vectors, norms)
    budget = reach(cosine, vectors.shape[1]) / TABLES / 2
    parts = _parts(turned.shape[1])
    signs = _words(turned >= 0)
    # A bit whose coordinate alone exceeds the reach can't differ.
    sure = _words(np.abs(turned) > math.sqrt(2 * TABLES * budget))
    mine, asking = np.flatnonzero(owns), np.flatnonzero(visits)
    for t in tables:
        part = parts[t]
        own = codes(turned[mine], part)
        order = np.argsort(own, kind="stable")
        mine_t, own = mine[order], own[order]
        for low in range(0, len(asking), 512):
            some = asking[low : low + 512]
            rows, wanted = probes(turned[some], part, budget)
            first, last = np.searchsorted(own, wanted), np.searchsorted(own, wanted, "right")
            met = last > first
            rows, first, last = rows[met], first[met], last[met]
            while len(rows):
                total = np.cumsum(last - first)
                upto = max(1, int(np.searchsorted(total, PAIRS, "right")))
                if upto == 1 and total[0] > PAIRS:  # one long range goes in pieces
                    cut = first[:1] + PAIRS
                    which, at = _expanded(first[:1], cut)
                    a = some[rows[:1]][which]
                    first = np.concatenate((cut, first[1:]))
                else:
                    which, at = _expanded(first[:upto], last[:upto])
                    a = some[rows[:upto]][which]
                    rows, first, last = rows[upto:], first[upto:], last[upto:]
                b = mine_t[at]
                fine = (ids[a] != ids[b]) & ~((signs[a] ^ signs[b]) & (sure[a] | sure[b])).any(axis=1)
                a, b = a[fine], b[fine]
                if not len(a):
                    continue
                near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= cosine
                a, b = a[near], b[near]
                differ = (turned[a] >= 0) != (turned[b] >= 0)
                once, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
                for u in range(t + 1):
                    costs = [(_energy(turned[x][:, parts[u]]) * differ[:, parts[u]]).sum(axis=1) <= budget for x in (a, b)]
                    if u == t:
                        once = open_ & costs[0] & ((ids[a] < ids[b]) | ~costs[1])
                    open_ &= ~(costs[0] | costs[1])
                yield a[once], b[once]


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Hang the roots of linked places together, the least place on top."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root[:] = root[root]


def _scaled(x: pa.Array, tops: np.ndarray) -> np.ndarray:
    """Vectors over powers of two, so that no product overflows or vanishes and nothing is rounded."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(tops), -1) / tops[:, None]


_LINKS = "node long, links long, over long"


def _group(rotations: dict[int, Rotation], cosine: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Of one group: (class, rows of other classes linked with it, a class of its component within the group)."""
        table = key[1].as_py()
        ids, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        vectors = _scaled(rows.column("x").combine_chunks(), rows.column("top").to_numpy())
        rotation = rotations.get(vectors.shape[1]) or plain(vectors.shape[1])
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        flags = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("visits", "owns"))
        for a, b in linked(vectors, rows.column("norm").to_numpy(), ids, *flags, rotation, range(TABLES) if table < 0 else [table], cosine):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            _forest(a, b, root)
        some = np.flatnonzero(links)
        return pa.table({"node": ids[some], "links": links[some], "over": ids[root[some]]})

    return run


def _spread(rotations: dict[int, Rotation], cosine: float):
    shape = ["node", "x", "top", "norm", "copies", "label", "dims"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each table and shard that it has an own code in or visits."""
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                rows = frame.slice(at, 256)
                dims, shards = rows.column("dims").to_numpy(), rows.column("shards").to_numpy()
                norms = rows.column("norm").to_numpy()
                for d in np.unique(dims):
                    some = np.flatnonzero(dims == d)
                    part_of = rows.take(pa.array(some))
                    vectors = _scaled(part_of.column("x"), part_of.column("top").to_numpy())
                    turned = (rotations.get(int(d)) or plain(int(d))).turned(vectors, norms[some])
                    budget = reach(cosine, int(d)) / TABLES / 2
                    for t, part in enumerate(_parts(turned.shape[1])):
                        if (shards[some] == 1).all():
                            row, shard = np.arange(len(some)), np.zeros(len(some), np.int64)
                        else:
                            row, code = probes(turned, part, budget)
                            shard = code * 0x9E3779B1 % (1 << 32) % shards[some][row]
                            pair = np.unique(row * (1 << 32) + shard)
                            row, shard = pair >> 32, pair & ((1 << 32) - 1)
                        home = codes(turned, part) * 0x9E3779B1 % (1 << 32) % shards[some]
                        out = part_of.take(pa.array(row)).select(shape)
                        more = {"t": pa.array(np.full(len(row), t, np.int32)), "shard": pa.array(shard), "owns": pa.array(shard == home[row])}
                        yield pa.RecordBatch.from_arrays([*out.columns, *more.values()], [*shape, *more])

    return run


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _links(classes: DataFrame, rotations: dict[int, Rotation], cosine: float, path: str) -> DataFrame:
    """(node, links, over) from all groups; a class may have several rows."""
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("size"))
    sizes = staged(sizes.withColumn("shards", F.ceil(F.col("size") / OWNERS).cast("long")), f"{path}/sizes")
    sized = classes.join(small_side(sizes), ["label", "dims"])
    columns = ["label", "dims", "t", "shard", "vb", "ob", "node", "x", "top", "norm", "copies", "visits", "owns"]
    none = F.lit(0).cast("long")
    whole = sized.filter(F.col("size") <= WHOLE).select("label", "dims", F.lit(-1).alias("t"), none.alias("shard"), none.alias("vb"), none.alias("ob"), "node", "x", "top", "norm", "copies", F.lit(True).alias("visits"), F.lit(True).alias("owns"))
    kind = dict(classes.dtypes)
    shape = f"node long, x {kind['x']}, top double, norm double, copies long, label {kind['label']}, dims int, t int, shard long, owns boolean"
    large = sized.filter(F.col("size") > WHOLE)
    spread = staged(large.select("node", "x", "top", "norm", "copies", "label", "dims", "shards").mapInArrow(_spread(rotations, cosine), shape), f"{path}/spread")
    keys = ["label", "dims", "t", "shard"]
    counts = spread.groupBy(keys).agg(F.ceil(F.count("*") / VISITORS).cast("long").alias("vs"), F.ceil(F.sum(F.col("owns").cast("long")) / OWNERS).cast("long").alias("os"))
    counts = staged(counts.filter("os > 0"), f"{path}/counts")
    dealt = spread.join(small_side(counts), keys)
    side = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    dealt = dealt.withColumn("v", side(F.col("vs"), 1)).withColumn("o", side(F.col("os"), 2))
    # As a visitor a row meets all owners' blocks, as an owner all visitors' blocks; where both meet it comes once.
    visiting = dealt.withColumn("ob", _upto(F.col("os"))).withColumn("vb", F.col("v")).withColumn("visits", F.lit(True)).withColumn("owns", F.col("owns") & (F.col("ob") == F.col("o")))
    owning = dealt.filter("owns").withColumn("vb", _upto(F.col("vs"))).filter("vb <> v").withColumn("ob", F.col("o")).withColumn("visits", F.lit(False))
    rows = whole.select(columns).unionByName(visiting.select(columns)).unionByName(owning.select(columns))
    # The group's table is its second key.
    return rows.groupBy("label", "t", "dims", "shard", "vb", "ob").applyInArrow(_group(rotations, cosine), _LINKS)


def fit(classes: DataFrame) -> dict[int, Rotation]:
    """A rotation for each of the commonest lengths, on a sample of at most ``SAMPLE`` vectors chosen by hash."""
    spark, found = classes.sparkSession, {}
    common = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(FITTED).collect()
    for dims, _ in common:
        some = classes.filter(F.col("dims") == dims).orderBy(F.xxhash64("x"), "node").limit(SAMPLE).select("x", "top", "norm").toArrow()
        vectors = _scaled(some.column("x").combine_chunks(), some.column("top").to_numpy())
        found[dims] = fitted(vectors / some.column("norm").to_numpy()[:, None])
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """All rows and columns with ``_n_links``, ``_component`` and ``_kept``.

    Rows link when their labels are equal, their vectors as long as each other and the cosine, in double precision, is at
    least ``cosine``. ``_n_links`` counts the other rows linked directly, equal ones included; ``_component`` is the
    smallest id reachable by links, the row's own included, and ``_kept`` tells whether that is its id. A row with a null
    label, a null or zero vector, or one with a null or non-finite component links with nothing; a null id counts as larger
    than all others. Rows that repeat an id are rows of their own. An empty table gives no rows. Columns of clashing
    names stay; ours then has underscores after its name.

    Equal vectors of a label are one class, so copies are never compared. Every pair of classes above the cosine is found,
    not most of them: see ``linked``. Counts and forests leave the tasks, not pairs. What no method avoids is that counting
    the links among n different vectors that are all near each other compares them all, which blocks spread.
    """
    link, root, kept = private(vectors, "_n_links", "_component", "_kept")
    x, usable, common = private(vectors, "x", "usable", "common")
    path = folder(vectors.sparkSession)
    kind = dict(vectors.dtypes)[embedding]
    value = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0) & F.col(label).isNotNull()
    rows = vectors.withColumn(x, value).withColumn(usable, F.coalesce(fine, F.lit(False)))
    top = F.max(F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))))))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / F.col("top"), 2)))
    classes = rows.filter(usable).groupBy(F.col(label).alias("label"), F.col(x).alias("x")).agg(F.count("*").alias("copies"), F.min(F.col(vec_id).cast("long")).alias("least"), top.alias("top"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("norm", norm).withColumn("dims", F.size("x")), f"{path}/classes")
    found = staged(_links(classes, fit(classes), cosine, path), f"{path}/links")
    edges = found.filter("node <> over").select(F.col("node").alias("u"), F.col("over").alias("v"))
    roots = components(edges, f"{path}/components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = told.groupBy("root").agg(F.min("least").alias("head"))
    told = staged(told.join(heads, "root").select("label", "x", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "head"), f"{path}/told")
    total = told.agg(F.sum("copies")).first()[0] or 0
    many = F.col("copies") >= max(2, math.ceil(total * COMMON))
    # At most 1 / COMMON classes are that common, so they may be broadcast; the others meet their few rows by a shuffle.
    names = private(rows, "class_label", "class_x", "class_links", "class_head")
    told, given = told.select("copies", *(F.col(c).alias(n) for c, n in zip(("label", "x", "links", "head"), names, strict=True))), vectors.columns
    same = (F.col(label) == F.col(names[0])) & (F.col(x) == F.col(names[1]))
    often, seldom = F.broadcast(told.filter(many).drop("copies")), told.filter(~many).drop("copies")
    marked = rows.join(often, same & F.col(usable), "left")
    rest = marked.filter(F.col(names[2]).isNull()).drop(*names)
    told = marked.filter(F.col(names[2]).isNotNull()).unionByName(rest.filter(usable).join(seldom, same, "left")).unionByName(rest.filter(~F.col(usable)), allowMissingColumns=True)
    head = F.coalesce(names[3], F.col(vec_id).cast("long"))
    return told.select(*given, F.coalesce(names[2], F.lit(0)).cast("long").alias(link), head.alias(root), F.col(vec_id).eqNullSafe(head).alias(kept))


#: The contract's rows as DuckDB SQL: all pairs of a label, then reachability.
SQL = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.r AS u, b.r AS v FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reached AS (SELECT r AS u, r AS v FROM usable UNION SELECT reached.u, links.v FROM reached JOIN links ON reached.v = links.u),
heads AS (SELECT reached.u, min(usable.vec_id) AS head FROM reached JOIN usable ON usable.r = reached.v GROUP BY reached.u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u),
told AS (SELECT usable.vec_id, coalesce(n, 0) AS n_links, head AS component_id FROM usable JOIN heads ON heads.u = r LEFT JOIN counts ON counts.u = r)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM told
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE label IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0 OR len(list_filter(embedding, lambda v: v <> 0)) = 0
"""
