"""Line deduplication by pairwise alignment."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import folder, private, small_side, staged

#: A common block of fewer bytes stays.
LEAST = 20
#: Stands for lines that no other text holds.
SPACER = 0


def patience(earlier: list[int], later: list[int]) -> list[tuple[int, int]]:
    """Aligned (earlier, later) line numbers of two lists of line hashes, ascending in both.

    Equal lines at both ends are aligned; between them the lines that are unique in both lists, in their longest common
    order, divide the rest, and each part is aligned alike.
    """
    found, parts = [], [(0, len(earlier), 0, len(later))]
    while parts:
        a, b, c, d = parts.pop()
        while a < b and c < d and earlier[a] == later[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and earlier[b - 1] == later[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(earlier[a:b]), Counter(later[c:d])
        place = {earlier[i]: i for i in range(a, b)}
        both = [(place[later[j]], j) for j in range(c, d) if theirs[later[j]] == 1 and ours.get(later[j]) == 1]
        tops: list[int] = []  # longest ascending run by patience sorting
        at: list[int] = []
        back = [-1] * len(both)
        for n, (i, _) in enumerate(both):
            k = bisect_left(tops, i)
            back[n] = at[k - 1] if k else -1
            tops[k : k + 1], at[k : k + 1] = [i], [n]
        n, anchors = (at[-1] if at else -1), []
        while n >= 0:
            anchors.append(both[n])
            n = back[n]
        last = (a, c)
        for i, j in reversed(anchors):
            parts.append((last[0], i, last[1], j))
            found.append((i, j))
            last = (i + 1, j + 1)
        if anchors:
            parts.append((last[0], b, last[1], d))
    return sorted(found)


def common_lines(earlier: list[int], later: list[int], sizes: list[int], least: int = LEAST) -> list[int]:
    """The later list's line numbers in aligned blocks (lines that follow each other in both) of ``least`` bytes or more."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*patience(earlier, later), (-2, -2)]:
        if before != (i - 1, j - 1):
            if sum(sizes[x] for x in block) >= least:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def reduced(hashes: list[int], shared: set[int]) -> tuple[list[int], list[int]]:
    """The text's shared lines with each run of others as one SPACER, and their line numbers.

    Patience alignment with another text is the same for it: lines that no other text holds only part the rest.
    """
    shape: list[int] = []
    places: list[int] = []
    for i, h in enumerate(hashes):
        if h in shared:
            shape.append(h)
            places.append(i)
        elif not shape or shape[-1] != SPACER:
            shape.append(SPACER)
            places.append(-1)
    return shape, places


def windows(shape: list[int], sizes: list[int], least: int = LEAST) -> dict[int, list[int]]:
    """Hash of a window -> the places it is for: each least run of shared lines of ``least`` bytes with the place in it.

    An aligned block that a place goes with holds one of the place's windows, so its holders are all that can remove it.
    """
    sums = [0, *accumulate(sizes)]
    found: dict[int, list[int]] = {}
    start = 0
    for end in [*(i for i, h in enumerate(shape) if h == SPACER), len(shape)]:
        filled = [i for i in range(start, end) if sizes[i]]
        for j in range(start, end):
            before = filled[: bisect_left(filled, j)]
            for s in [j, *reversed(before)]:
                e = max(bisect_left(sums, sums[s] + least, s), j + 1)
                if e <= end and (s == j or sums[e] - sums[s + 1] < least):
                    places = found.setdefault(hash((j - s, *shape[s:e])), [])
                    places.append(j)
                if e == j + 1:
                    break
        start = end + 1
    return found


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, places, sizes, keys = [], [], [], []
        for hashes, known, size in zip(*(batch.column(c).to_pylist() for c in ("hashes", "shared", "sizes")), strict=True):
            blank = {h for h, n in zip(hashes, size, strict=True) if not n}
            shape, at = reduced(hashes, blank.union(known))
            shapes.append(shape)
            places.append(at)
            sizes.append([size[i] if i >= 0 else 0 for i in at])
            keys.append(md5(array("q", shape).tobytes()).hexdigest())
        arrays = [batch.column("node"), batch.column("order"), pa.array(keys, pa.string()), pa.array(shapes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "order", "shape", "hashes", "places", "sizes"])


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows(h, n, least) for h, n in zip(batch.column("hashes").to_pylist(), batch.column("sizes").to_pylist(), strict=True)]
            keys, at = pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("shape"), batch.column("first"), batch.column("last"), keys, at], ["shape", "first", "last", "keys", "at"])

    return run


def _aligned(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("ours", "theirs", "sizes")), strict=True)
            gone = [common_lines([-1 if h == SPACER else h for h in b], a, n, least) for a, b, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("later"), batch.column("since"), pa.array(gone, pa.list_(pa.int32()))], ["shape", "since", "gone"])

    return run


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _cut(held: DataFrame, classes: DataFrame, least: int, path: str) -> DataFrame:
    """(shape, since): the places of each shape that an aligned holder removes, each with the earliest such holder."""
    ours = classes.select(F.col("shape").alias("later"), F.col("hashes").alias("ours"), "sizes")
    theirs = classes.select(F.col("shape").alias("earlier"), F.col("hashes").alias("theirs"), F.col("first").alias("since"))
    holders = held.select("key", F.col("shape").alias("earlier"), F.col("first").alias("since"), "nth")
    goal = held.select("shape", "last", "key", "holders", F.explode("at").alias("at"))
    tried, found, low, high = None, None, 0, 1
    most = held.agg(F.max("holders")).first()[0] or 0
    while low < most or found is None:
        wanted = goal.filter(F.col("holders") > low)
        if found is None:
            wanted = wanted.withColumn("until", F.col("last"))
        else:  # a place that is found can only be found earlier
            wanted = wanted.join(found, ["shape", "at"], "left").withColumn("until", F.least("last", "first"))
        wanted = wanted.groupBy("shape", "key").agg(F.max("until").alias("until"))
        pairs = wanted.join(holders.filter((F.col("nth") >= low) & (F.col("nth") < high)), "key").filter(F.col("since") < F.col("until")).select(F.col("shape").alias("later"), "earlier").distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["later", "earlier"], "left_anti"), f"{path}/pairs{high}")
        gone = pairs.join(theirs, "earlier").join(ours, "later").select("later", "since", "ours", "theirs", "sizes").mapInArrow(_aligned(least), "shape string, since struct<last: boolean, id: bigint, node: string>, gone array<int>")
        gone = gone.select("shape", F.explode("gone").alias("at"), F.col("since").alias("first"))
        gone = gone if found is None else gone.unionByName(found)
        found = staged(gone.groupBy("shape", "at").agg(F.min("first").alias("first")), f"{path}/found{high}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        low, high = high, high * 16
    return found.groupBy("shape").agg(F.collect_list(F.struct("at", "first")).alias("since"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``docs`` with _n_lines, _removed (line numbers from 0) and _kept, the text without those lines.

    A later document loses each line that is in an aligned common block with any earlier one: the result is that of
    aligning all pairs. Texts that differ only in lines no other text holds are one shape, as they align alike. Shapes
    are aligned with holders of their windows, earliest first and ever more of them, until each line is removed or all its
    holders were tried. Blocks are judged on the texts as given. Of equal texts all lines of the later ones go.

    Later means a larger doc_id, and a null id comes last; texts of one id are ordered by their hash. Rows that repeat an
    id and text share one result. Null and empty texts have one empty line and keep it. Columns of these names are replaced.
    """
    path = folder(docs.sparkSession)
    node = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    listed = docs.select(F.col(doc_id).cast("long").alias("id"), node.alias("node"), _lines(F.col(text)).alias("lines"))
    listed = listed.select("id", "node", F.transform("lines", lambda x: F.xxhash64(F.rtrim(x))).alias("hashes"), F.transform("lines", lambda x: F.octet_length(F.trim(x))).alias("sizes"))
    # One row for each different text; copies are counted where they are before any shuffle.
    texts = listed.groupBy("node").agg(F.struct(F.min("id").isNull().alias("last"), F.min("id").alias("id"), F.col("node")).alias("order"), F.any_value("hashes").alias("hashes"), F.any_value("sizes").alias("sizes"))
    texts = staged(texts, f"{path}/texts")
    filled = F.array_distinct(F.transform(F.filter(F.arrays_zip("hashes", "sizes"), lambda x: x["sizes"] > 0), lambda x: x["hashes"]))
    lines = texts.select("node", "order", F.explode(filled).alias("line"))
    known = lines.groupBy("line").agg(F.count("*").alias("holders")).filter("holders > 1").select("line")
    shared = lines.join(small_side(known), "line").groupBy("node").agg(F.collect_list("line").alias("shared"))
    order = "order struct<last: boolean, id: bigint, node: string>"
    shapes = texts.join(shared, "node").select("node", "order", "hashes", "sizes", "shared").mapInArrow(_reduced, f"node string, {order}, shape string, hashes array<bigint>, places array<int>, sizes array<int>")
    shapes = staged(shapes, f"{path}/shapes")
    classes = shapes.groupBy("shape").agg(F.min("order").alias("first"), F.max("order").alias("last"), F.any_value("hashes").alias("hashes"), F.any_value("sizes").alias("sizes"))
    classes = staged(classes, f"{path}/classes")
    held = classes.mapInArrow(_windows(least), f"shape string, {order.replace('order', 'first', 1)}, {order.replace('order', 'last', 1)}, keys array<bigint>, at array<array<int>>")
    held = held.select("shape", "first", "last", F.explode(F.arrays_zip("keys", "at")).alias("x")).select("shape", "first", "last", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    by_key = W.partitionBy("key")
    held = held.withColumn("holders", F.count("*").over(by_key)).withColumn("nth", F.row_number().over(by_key.orderBy("first")) - 1).withColumn("used", F.min("first").over(by_key) < F.max("last").over(by_key))
    held = staged(held.filter("used").drop("used"), f"{path}/held")
    cut = _cut(held, classes, least, path)
    cut = shapes.join(cut, "shape").select("node", F.sort_array(F.transform(F.filter("since", lambda x: x["first"] < F.col("order")), lambda x: F.element_at("places", x["at"] + 1))).alias("gone")).filter(F.size("gone") > 0)
    first = texts.select("node", F.col("order.id").alias("first"), F.aggregate("sizes", F.lit(0), lambda a, x: a + x).alias("bytes"))
    docs = docs.drop(*(c for c in ("_n_lines", "_removed", "_kept") if c not in (text, doc_id)))
    name, gone, least_id, size, listed = private(docs, "node", "gone", "first", "bytes", "lines")
    known = first.join(cut, "node", "left").select(F.col("node").alias(name), F.col("gone").alias(gone), F.col("first").alias(least_id), F.col("bytes").alias(size))
    known = staged(known, f"{path}/cut")

    out = docs.withColumn(name, node).join(known, name, "left").withColumn(listed, _lines(F.col(text)))
    copy = ~F.col(doc_id).cast("long").eqNullSafe(F.col(least_id)) & (F.col(size) >= least)
    every = F.sequence(F.lit(0), F.size(listed) - 1)
    out = out.withColumn("_removed", F.when(copy, every).otherwise(F.coalesce(gone, F.array().cast("array<int>"))))
    kept = F.when(F.size("_removed") == 0, F.coalesce(F.col(text).cast("string"), F.lit(""))).otherwise(F.array_join(F.filter(listed, lambda x, i: ~F.array_contains("_removed", i)), "\n"))
    return out.withColumn("_n_lines", F.size(listed)).withColumn("_kept", kept).drop(name, least_id, size, gone, listed)
