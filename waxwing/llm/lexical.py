"""Ranked lexical search over a two-level quantised index: byte impacts bound scores, exact integers decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import folder, small_side, staged, text_bytes

#: Fixed values of the score: an impact is (SCALE * tf) div (1000 * tf + 8 * m), where m = 25 + (75 * n * N) div L.
SCALE, STEEP, FLAT, SLOPE, TENTHS = 1_000_000_000, 1000, 25, 75, 8
#: No impact exceeds this; a byte stands for so many of STEPS equal steps of it.
MOST, STEPS = SCALE // STEEP, 255
#: Bytes of text, and documents, of one block of the index.
BLOCK, DOCUMENTS = 1 << 22, 4096
#: Items, and terms of items, that one round of the search broadcasts at most (but for one item with more terms).
ITEMS, ITEM_TERMS = 1024, 500_000
#: Cells of a block's matrix of terms and documents that a task holds at once.
CELLS = 1 << 22
#: A bound this near to the kth counts as reaching it.
SLACK = 1 - 2**-30
K = 10

_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_low:_high] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Collection:
    """Documents with at least one term, and all their terms with repeats."""

    documents: int
    terms: int

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of one term in documents of n terms each, as whole numbers."""
        m = FLAT + (SLOPE * n.astype(np.int64) * self.documents) // self.terms
        return (SCALE * tf.astype(np.int64)) // (STEEP * tf.astype(np.int64) + TENTHS * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def upward(impacts: np.ndarray) -> np.ndarray:
    """The least byte whose steps reach the impact."""
    return (-(-impacts * STEPS // MOST)).astype(np.uint8)


def _upper(levels: np.ndarray) -> np.ndarray:
    """The largest impact that a byte may stand for."""
    return levels.astype(np.int64) * MOST // STEPS


def _lower(levels: np.ndarray) -> np.ndarray:
    """An impact that all of a byte's reach."""
    return np.maximum(levels.astype(np.int64) - 1, 0) * MOST // STEPS


def _slices(frame: pa.RecordBatch, sizes: np.ndarray, block: int = BLOCK, documents: int = DOCUMENTS) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most so many bytes, but for a longer single row, and so many rows."""
    ends, row = np.cumsum(sizes), 0
    while row < len(sizes):
        before = int(ends[row - 1]) if row else 0
        end = max(row + 1, min(row + documents, int(np.searchsorted(ends, before + block, "right"))))
        yield frame.slice(row, end - row)
        row = end


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts (binary), A-Z as a-z, and for each the row that it lies in."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _TERM[flat]
    first = np.zeros(len(flat) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    letters = _LOWER[flat[inside]]
    # A term begins among the letters at the number of letters before it.
    begins = np.cumsum(inside)[starts] - 1
    ends = np.append(begins, len(letters)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return found, np.searchsorted(at, starts, "right") - 1


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False)


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for frame in frames:
        for part in _slices(frame, _sizes(frame.column(0))):
            rows = terms_of(part.column(0))[1]
            documents, terms = documents + len(np.unique(rows)), terms + len(rows)
    yield pa.RecordBatch.from_pydict({"documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})


def collection(docs: DataFrame, text: str = "text") -> Collection:
    """The collection's figures, in one pass that moves two numbers a task."""
    sums = docs.select(text_bytes(text)).mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return Collection(sums[0] or 0, sums[1] or 0)


def _indexed(figures: Collection):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block of documents, for each of its terms in order: the documents, their bytes and their counts."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for frame in frames:
            for part in _slices(frame, _sizes(frame.column(1)), BLOCK, DOCUMENTS):
                found, rows = terms_of(part.column(1))
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                size = len(part)
                cells, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * size + rows, return_counts=True)
                term, doc = cells // size, (cells % size).astype(np.int32)
                n = np.bincount(rows, minlength=size)
                levels = upward(figures.impacts(tf, n[doc]))
                ends = np.append(np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))), len(term)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (doc, tf)]
                bytes_ = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(levels)])
                words = coded.dictionary.cast(pa.binary()).cast(pa.string())
                columns = [pa.array(np.full(len(words), block)), words, lists[0], bytes_, lists[1], pa.nulls(len(words), pa.list_(pa.int64())), pa.nulls(len(words), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, _INDEX)
                held = np.flatnonzero(n).astype(np.int32)
                one = pa.array([0, len(held)], pa.int32())
                ids = part.column(0).take(pa.array(held))
                lists = [pa.ListArray.from_arrays(one, x) for x in (ids, pa.array(held), pa.array(n[held].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.string()), lists[1], pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int32())), lists[0], lists[2]], _INDEX)
                block += 1

    return run


_INDEX = ["block", "term", "docs", "levels", "tfs", "ids", "ns"]
_SHAPE = "block long, term string, docs array<int>, levels binary, tfs array<int>, ids array<long>, ns array<int>"


@dataclass(frozen=True)
class Index:
    """The written index: its first level is (block, term, docs, levels), its second (block, term, docs, tfs), and a row
    without term holds each block's documents with their ids and sizes. A scan reads the columns of one of them."""

    figures: Collection
    table: DataFrame


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index all documents. A task holds one block at a time, of some megabytes or one long text; nothing is shuffled."""
    figures = collection(docs, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_bytes(text).alias("data")).mapInArrow(_indexed(figures), _SHAPE)
    return Index(figures, staged(rows, f"{folder(docs.sparkSession)}/postings"))


def _item_terms(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for part in _slices(frame, _sizes(frame.column(1))):
            found, rows = terms_of(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), found.cast(pa.binary()).cast(pa.string())], ["item_id", "term"])


@dataclass(frozen=True)
class Asked:
    """A round's items: their terms in order, and for each item (row) and term (column) the weight times its repeats."""

    ids: list[int | None]
    terms: dict[str, int]
    items: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    def matrix(self, low: int, high: int, columns: np.ndarray) -> np.ndarray:
        """The weights of the items low to high - 1 in some columns, in ascending order."""
        a, b = np.searchsorted(self.items, (low, high))
        at = np.searchsorted(columns, self.columns[a:b])
        here = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == self.columns[a:b])
        out = np.zeros((high - low, len(columns)))
        out[self.items[a:b][here] - low, at[here]] = self.weights[a:b][here]
        return out


def _blocks(frames: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list]]:
    """(block, columns of its rows) from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for frame in frames:
        block = frame.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield _joined(held, names)
                held = []
            if b > a:
                held.append(frame.slice(a, b - a))
    if held:
        yield _joined(held, names)


def _joined(parts: list[pa.RecordBatch], names: tuple[str, ...]) -> tuple[int, list]:
    table = pa.Table.from_batches(parts).combine_chunks()
    return table.column("block")[0].as_py(), [table.column(n).combine_chunks() for n in names]


def _bounded(shared, k: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, block, doc, upper, lower) of the documents whose upper bound reaches the task's kth lower bound so far."""
        asked: Asked = shared.value
        best = np.zeros((len(asked.ids), k))
        for block, (terms, docs, levels) in _blocks(frames, ("term", "docs", "levels")):
            columns = np.array([asked.terms[t] for t in terms.to_pylist()], np.int64)
            order = np.argsort(columns)
            size = np.diff(docs.offsets.to_numpy())
            at = docs.flatten().to_numpy()
            level = np.frombuffer(b"".join(levels.to_pylist()), np.uint8)
            held, place = np.unique(at, return_inverse=True)
            row = np.empty(len(order), np.int64)
            row[order] = np.arange(len(order))
            row = np.repeat(row, size)
            step = max(1, CELLS // len(order))
            for first in range(0, len(held), step):
                here = np.flatnonzero((place >= first) & (place < first + step))
                cells = np.zeros((len(order), min(step, len(held) - first)))
                for low in range(0, len(asked.ids), 256):
                    high = min(low + 256, len(asked.ids))
                    weights = asked.matrix(low, high, columns[order])
                    # Whole numbers, exact below 2**53; SLACK covers what larger sums round.
                    cells[row[here], place[here] - first] = _upper(level[here])
                    upper = weights @ cells
                    cells[row[here], place[here] - first] = _lower(level[here])
                    lower = weights @ cells
                    near = np.concatenate((best[low:high], lower), axis=1)
                    best[low:high] = np.partition(near, near.shape[1] - k, axis=1)[:, -k:]
                    i, d = np.nonzero((upper > 0) & (upper >= best[low:high].min(axis=1)[:, None] * SLACK))
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"item": pa.array((i + low).astype(np.int32)), "block": pa.array(np.full(len(i), block)), "doc": pa.array(held[first + d]), "upper": pa.array(upper[i, d].astype(np.int64)), "lower": pa.array(lower[i, d].astype(np.int64))})

    return run


def _exact(shared, figures: Collection):
    def run(key: tuple[pa.Scalar, ...], wanted: pa.Table, rows: pa.Table) -> pa.Table:
        """(item, doc_id, score) of one block's wanted documents, term by term in whole numbers."""
        asked: Asked = shared.value
        if not wanted.num_rows or not rows.num_rows:
            return pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        heads = rows.filter(pc.is_null(rows.column("term"))).combine_chunks()
        held, ids, ns = (heads.column(c).combine_chunks().flatten() for c in ("docs", "ids", "ns"))
        size_of = dict(zip(held.to_pylist(), ns.to_pylist(), strict=True))
        id_of = dict(zip(held.to_pylist(), ids.to_pylist(), strict=True))
        items, docs = wanted.column("item").to_numpy(), wanted.column("doc").to_numpy()
        order = np.lexsort((docs, items))
        items, docs = items[order], docs[order]
        distinct, place = np.unique(docs, return_inverse=True)
        n = np.array([size_of[d] for d in distinct.tolist()], np.int64)
        postings = rows.filter(pc.is_valid(rows.column("term"))).combine_chunks()
        terms, lists, counts = (postings.column(c).combine_chunks() for c in ("term", "docs", "tfs"))
        column = np.repeat(np.array([asked.terms[t] for t in terms.to_pylist()], np.int64), np.diff(lists.offsets.to_numpy()))
        at, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
        here = np.isin(at, distinct)
        column, at, tf = column[here], np.searchsorted(distinct, at[here]), tf[here]
        impact = figures.impacts(tf, n[at])
        # Of each document its postings by column.
        by_doc = np.lexsort((column, at))
        column, at, impact = column[by_doc], at[by_doc], impact[by_doc]
        score = np.zeros(len(items), np.int64)
        bounds = np.searchsorted(at, np.arange(len(distinct) + 1))
        for i in np.unique(items).tolist():
            a, b = np.searchsorted(asked.items, (i, i + 1))
            mine, weight = asked.columns[a:b], asked.weights[a:b].astype(np.int64)
            for j in range(*np.searchsorted(items, (i, i + 1)).tolist()):
                low, high = bounds[place[j]], bounds[place[j] + 1]
                where = np.searchsorted(mine, column[low:high])
                met = (where < len(mine)) & (mine[np.minimum(where, len(mine) - 1)] == column[low:high])
                score[j] = (weight[where[met]] * impact[low:high][met]).sum()
        return pa.table({"item": pa.array(items, pa.int32()), "doc_id": pa.array([id_of[d] for d in docs.tolist()], pa.int64()), "score": pa.array(score)})

    return run


def _asked(rows: list, weights: dict[str, int]) -> Asked:
    ids = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x or 0))
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    number = {x: i for i, x in enumerate(ids)}
    cells = sorted((number[r["item_id"]], terms[r["term"]], weights[r["term"]] * r["repeats"]) for r in rows)
    items, columns, weight = (np.array(x) for x in zip(*cells, strict=True))
    return Asked(ids, terms, items.astype(np.int64), columns.astype(np.int64), weight.astype(np.float64))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k first of each item: of each part of its rows first, so that no task sees all documents of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = scored.withColumn("part", F.spark_partition_id()).withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(held: Index, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, ties by id, null ids last.

    The first level bounds all scores by byte impacts; what reaches the kth best lower bound is scored anew from the second
    level, so the result is exact. Items go in rounds whose terms and weights are broadcast, ``ITEMS`` items and
    ``ITEM_TERMS`` terms at most. Rows of items that repeat count once, different texts of one id together; an item
    without terms, or none of which any document holds, gives no rows.
    """
    spark, path = items.sparkSession, folder(items.sparkSession)
    given = items.select(F.col(item_id).cast("long").alias("item_id"), text_bytes(text).alias("data")).distinct()
    asked = given.mapInArrow(_item_terms, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("repeats"))
    asked = staged(asked, f"{path}/asked")
    size = asked.agg(F.count_distinct(F.coalesce("item_id", F.lit(-1))), F.count("*")).first()
    rounds = max(1, -(-2 * size[0] // ITEMS) if size[0] > ITEMS else 1, -(-2 * size[1] // ITEM_TERMS) if size[1] > ITEM_TERMS else 1)
    vocabulary = asked.select("term").distinct()
    postings = held.table.filter("term is not null")
    frequencies = staged(postings.select("term", F.size("docs").alias("df")).join(small_side(vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")), f"{path}/frequencies")
    asked = staged(asked.join(small_side(frequencies), "term").withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds))), f"{path}/known")
    found = []
    for r in range(rounds):
        rows = asked.filter(F.col("round") == r).collect()
        if not rows:
            continue
        round_ = _asked(rows, {x["term"]: held.figures.weight(x["df"]) for x in rows})
        shared = spark.sparkContext.broadcast(round_)
        words = small_side(spark.createDataFrame([(t,) for t in round_.terms], "term string"))
        level = held.table.select("block", "term", "docs", "levels").join(words, "term", "left_semi")
        level = level.repartition("block").sortWithinPartitions("block")
        near = staged(level.mapInArrow(_bounded(shared, k), "item int, block long, doc int, upper long, lower long"), f"{path}/{r}/bounds")
        # The kth lower bound, from the k best of each part.
        lows = near.withColumn("part", F.pmod("block", F.lit(64)))
        lows = lows.withColumn("nth", F.row_number().over(W.partitionBy("item", "part").orderBy(F.desc("lower")))).filter(F.col("nth") <= k)
        lows = lows.withColumn("nth", F.row_number().over(W.partitionBy("item").orderBy(F.desc("lower")))).filter(F.col("nth") == k).select("item", F.col("lower").alias("least"))
        # At most as many rows as items in a round.
        wanted = staged(near.join(F.broadcast(lows), "item", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least") * SLACK)).select("item", "block", "doc"), f"{path}/{r}/wanted")
        second = held.table.select("block", "term", "docs", "tfs", "ids", "ns").join(small_side(wanted.select("block").distinct()), "block", "left_semi")
        second = second.filter("term is not null").join(words, "term", "left_semi").unionByName(second.filter("term is null"))
        scored = wanted.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(_exact(shared, held.figures), "item int, doc_id long, score long")
        ids = spark.createDataFrame(list(enumerate(round_.ids)), "item int, item_id long")
        best = _best(scored.filter("score > 0"), k).join(F.broadcast(ids), "item")
        found.append(best.select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``search`` over an index of all documents. Null and empty texts hold no terms; rows that repeat are documents of
    their own; tables without rows give none; other columns play no part."""
    return search(index(docs, doc_id, text), items, k, item_id, item_text)


#: The contract's rows as DuckDB SQL.
SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
figures AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM lowered WHERE len(terms) > 0),
held AS (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM lowered),
counted AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM held GROUP BY ALL),
frequency AS (SELECT term, count(*)::BIGINT AS df FROM counted GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
repeated AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM asked GROUP BY ALL),
weighed AS (SELECT item_id, term, repeats * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM repeated JOIN frequency USING (term), figures),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM weighed JOIN counted USING (term), figures GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM numbered WHERE rank <= 10
"""
