"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else in the corpus. Each window of SPAN bytes
has an anchor, the leftmost least hash of its GRAM-byte grams; equal windows have equal anchors at equal places. A
segment is the run of windows of one anchor. So:

1. Segments of equal bytes are found by a hash, those of one batch before any shuffle; all of their windows repeat.
2. A segment that is unlike all others, but whose anchor's gram occurs elsewhere, may share some windows. Those, and one
   segment of each other kind with that gram, are dealt by gram into shards of a bounded number of segments.
3. Each shard sorts its suffixes by Larsson-Sadakane refinement (ranks of h bytes give ranks of 2h; sorted groups
   are left alone) and finds the common prefixes of neighbours by Kasai's carry, along all segments at once. A window whose
   suffix shares SPAN bytes with a neighbour's repeats.
4. A gram with more segments than a shard holds has several shards. Their windows' digests are sorted, dealt out by
   value, and merged by binary search of each shard's run in the others'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import U, binary_chunks, mix, powers, prefix_hash
from .work import folder, private, shuffle_partitions, small_side, staged, text_bytes

SPAN, GRAM = 200, 64
#: Segments in a shard of suffixes, and bytes of a text that are looked at at once (with SPAN - 1 of overlap).
SHARD, PIECE = 2048, 1 << 22
_TABLE = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 64, 256, dtype=U)
_SEGMENT = np.dtype([("gram", "u8"), ("seg", "u8"), ("node", "i8"), ("start", "u4"), ("windows", "u1"), ("many", "u1")])
_PLACE = U((1 << 24) - 1)


def segments(data: np.ndarray) -> np.ndarray:
    """The segments of a text of SPAN bytes or more, in order of their starts; ``node`` and ``many`` are 0."""
    parts = []
    for at in range(0, max(1, len(data) - SPAN + 1), PIECE):
        part = data[at : at + PIECE + SPAN - 1]
        sums, (_, back) = prefix_hash(part, _TABLE), powers(len(part) + 1)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: len(part) - GRAM + 1])
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)  # the leftmost of equals
        width, windows = 1, SPAN - GRAM + 1
        while 2 * width <= windows:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (windows - width)], least[windows - width :])
        anchor = (least & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        end = np.append(start[1:], len(anchor))  # one past the last window
        out = np.zeros(len(start), _SEGMENT)
        out["gram"], out["start"], out["windows"] = grams[anchor[start]], start + at, end - start
        place = (anchor[start] - start).astype(U)
        out["seg"] = mix((sums[end - 1 + SPAN] - sums[start]) * back[start] + place * U(0xA0761D6478BD642F) + (end - start).astype(U) * U(0xE7037ED1A0B428DB))
        parts.append(out)
    return np.concatenate(parts)


def node_spans(node: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (node, start, end) in order, those of a node without overlap or contact."""
    if not len(node):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, node))
    node, start, end = node[order], start[order], end[order]
    fresh = np.concatenate(([True], node[1:] != node[:-1]))
    # Ends lifted above all of the nodes before, so that one running maximum serves all nodes.
    lift = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + lift)
    first = np.flatnonzero(fresh | np.concatenate(([True], (start + lift)[1:] > top[:-1])))
    last = np.append(first[1:], len(node)) - 1
    return np.stack([node[first], start[first], top[last] - lift[last]], 1)


def _dealt(held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A batch's segments, one of each kind, packed by bucket of gram; and, packed in buckets below 0 by node, the spans
    (node, start, end) of those of which the batch has several."""
    rows = np.concatenate(held)
    rows = rows[np.argsort(rows["seg"], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], rows["seg"][1:] != rows["seg"][:-1])))
    count = np.diff(np.append(first, len(rows)))
    again = rows[np.repeat(count > 1, count)]
    spans = node_spans(again["node"], again["start"].astype(np.int64), again["start"].astype(np.int64) + again["windows"] - 1 + SPAN)
    rows = rows[first]
    rows["many"] = count > 1
    names, packed = [], []
    for part, bucket, sign in ((rows, (rows["gram"] % U(buckets)).astype(np.int64), 1), (spans, spans[:, 0] % buckets + 1, -1)):
        part = part[np.argsort(bucket, kind="stable")]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets + 1))
        for i, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if y > x:
                names.append(sign * i)
                packed.append(part[x:y].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])


def _found(buckets: int):
    """Texts -> packed segments by bucket of gram, and packed spans that repeat within a batch (buckets below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of one task give their segments once
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for row, end, data, at in binary_chunks(batch.column("text")):
                for i in range(row, end):
                    if nodes[i] in seen:
                        continue
                    seen.add(nodes[i])
                    own = segments(data[at[i - row] : at[i - row + 1]])
                    own["node"] = nodes[i]
                    held.append(own)
                    size += len(own)
                if size > 500_000:
                    yield _dealt(held, buckets)
                    held, size = [], 0
        if held:
            yield _dealt(held, buckets)

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """Of a bucket's segments: those that repeat as a whole (kind 0), and those whose windows must be compared: unique
    ones with a shared gram (kind 1) and one of each repeated kind beside such (kind 2). ``width`` counts a gram's."""
    packed = b"".join(table.column("packed").to_pylist())
    if table.column("bucket")[0].as_py() < 0:
        spans = np.frombuffer(packed, np.int64).reshape(-1, 3)
        zero = np.zeros(len(spans), np.int64)
        return _found_table(zero, zero, spans[:, 0], spans[:, 1], spans[:, 2], zero)
    rows = np.frombuffer(packed, _SEGMENT)
    rows = rows[np.lexsort((rows["seg"], rows["gram"]))]
    new_gram = np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1]))
    first = new_gram | np.concatenate(([True], rows["seg"][1:] != rows["seg"][:-1]))
    seg, gram = np.cumsum(first) - 1, np.cumsum(new_gram) - 1
    here = np.bincount(seg)[seg]
    whole = (here > 1) | (np.bincount(seg, rows["many"]) > 0)[seg]
    unique = ~whole & (np.bincount(gram, first)[gram] > 1)
    beside = first & whole & (np.bincount(gram, unique)[gram] > 0)
    width = np.bincount(gram, unique | beside)[gram].astype(np.int64)
    picks = [np.flatnonzero(whole & (here > 1)), np.flatnonzero(unique), np.flatnonzero(beside)]
    at, kind = np.concatenate(picks), np.repeat([0, 1, 2], [len(x) for x in picks])
    start = rows["start"][at].astype(np.int64)
    return _found_table(kind, rows["gram"][at].astype(np.int64), rows["node"][at], start, start + rows["windows"][at] - 1 + SPAN, width[at])


def _found_table(kind, gram, node, start, end, width) -> pa.Table:
    return pa.table({"kind": pa.array(kind.astype(np.int32)), "gram": pa.array(gram), "node": pa.array(np.ascontiguousarray(node)), "start": pa.array(np.ascontiguousarray(start)), "end": pa.array(np.ascontiguousarray(end)), "width": pa.array(width)})


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for node, text, parts in zip(batch.column("node").to_pylist(), batch.column("text"), batch.column("parts").to_pylist(), strict=True):
            data = memoryview(text.as_buffer())
            rows += [(node, p["gram"], p["shard"], p["start"], p["kind"], p["split"], bytes(data[p["start"] : p["end"]])) for p in parts]
            if len(rows) > 20_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["node", "gram", "shard", "start", "kind", "split", "bytes"])


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of strings laid end to end, with ``left`` bytes to its string's end from each place on.

    Ranks of the first 8 bytes are refined by doubling, and only within groups of equal rank. Suffixes that are equal to
    their ends stay in the order of their places.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | np.where(left > i, padded[i : i + n], 0).astype(U)
    order = np.lexsort((np.minimum(left, 8), key))  # of equal bytes the shorter first
    key_, left_ = key[order], np.minimum(left, 8)[order]
    fresh = np.concatenate(([True], (key_[1:] != key_[:-1]) | (left_[1:] != left_[:-1])))
    first = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = first[np.cumsum(fresh) - 1]
    size = np.diff(np.append(first, n))
    open_ = np.flatnonzero(np.repeat(size, size) > 1)  # places in the order that lie in a group of several
    h = 8
    while h < left.max(initial=0) and len(open_):
        at = order[open_]
        after = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        own = rank[at]
        sort = np.argsort(own * (n + 2) + after, kind="stable")
        at, own, after = at[sort], own[sort], after[sort]
        order[open_] = at
        group = np.concatenate(([True], own[1:] != own[:-1]))
        fresh = group | np.concatenate(([True], after[1:] != after[:-1]))
        place = np.arange(len(at))
        base = place[group][np.cumsum(group) - 1]
        head = place[fresh][np.cumsum(fresh) - 1]
        rank[at] = own + head - base
        size = np.diff(np.append(np.flatnonzero(fresh), len(at)))
        open_ = open_[np.repeat(size, size) > 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, left: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """For each suffix the bytes, at most ``depth``, that it shares with the one before it in the order.

    Kasai's carry: one byte further on, a suffix shares at least one byte less with its neighbour. All strings are walked
    at once, each from its own start.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)
    at, carry = starts.copy(), np.zeros(len(starts), np.int64)
    while len(at):
        other = before[at]
        most = np.where(other >= 0, np.minimum(np.minimum(left[at], left[other]), depth), 0)
        h = np.minimum(np.maximum(carry - 1, 0), most)
        live = np.flatnonzero(h < most)
        while len(live):
            same = data[at[live] + h[live]] == data[other[live] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < most[live]]
        common[at] = h
        more = left[at] > 1
        at, carry = at[more] + 1, h[more]
    return common


def _compared(table: pa.Table) -> pa.Table:
    """Spans of windows that repeat within a bucket of shards; and, of grams with several shards, the digests of each
    shard's different windows."""
    node, start, shard, gram, kind = (table.column(c).to_numpy() for c in ("node", "start", "shard", "gram", "kind"))
    split, strings = table.column("split").to_numpy(zero_copy_only=False), table.column("bytes").to_pylist()
    order = np.lexsort((start, node, shard, gram))
    new = np.concatenate(([True], (np.diff(gram[order]) != 0) | (np.diff(shard[order]) != 0)))
    order = order[new | np.concatenate(([True], (np.diff(node[order]) != 0) | (np.diff(start[order]) != 0)))]  # a segment once
    new = np.concatenate(([True], (np.diff(gram[order]) != 0) | (np.diff(shard[order]) != 0)))
    heads = np.flatnonzero(new)
    blocks = np.split(order, heads[np.flatnonzero(np.diff(heads // SHARD)) + 1])  # whole shards, about SHARD segments
    spans, digests = [np.zeros((0, 3), np.int64)], [np.zeros((0, 4), np.int64)]
    for block in blocks:
        parts = [strings[i] for i in block.tolist()]
        size = np.array([len(x) for x in parts])
        data, begin = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1]))
        owner = np.repeat(np.arange(len(block)), size)
        left = (begin + size)[owner] - np.arange(len(data))
        at = suffix_array(data, left)
        near = common_prefixes(data, left, begin, at) >= SPAN  # equal to the window before it in the order
        again = near.copy()
        again[at[:-1]] |= near[at[1:]]
        place = start[block][owner] + np.arange(len(data)) - begin[owner]
        hit = np.flatnonzero(again & (kind[block] == 1)[owner])
        spans.append(node_spans(node[block][owner[hit]], place[hit], place[hit] + SPAN))
        if (of := split[block]).any():
            own = np.flatnonzero((left >= SPAN) & ~near & of[owner])  # of equal windows the first
            sums, (_, back) = prefix_hash(data, _TABLE), powers(len(data) + 1)
            digest = mix((sums[own + SPAN] - sums[own]) * back[own]).astype(np.int64)
            digests.append(np.stack([node[block][owner[own]], place[own], digest, shard[block][owner[own]]], 1))
    spans, digests = np.concatenate(spans), np.concatenate(digests)
    none = [None] * len(spans)
    return pa.table(
        {
            "node": pa.array(np.concatenate((spans[:, 0], digests[:, 0]))),
            "start": pa.array(np.concatenate((spans[:, 1], digests[:, 1]))),
            "end": pa.array(np.concatenate((spans[:, 2], digests[:, 1] + SPAN))),
            "digest": pa.array(none + digests[:, 2].tolist(), pa.int64()),
            "shard": pa.array(none + digests[:, 3].tolist(), pa.int64()),
        }
    )


def _merged(table: pa.Table) -> pa.Table:
    """Windows of one range of digests that another shard's sorted run holds too, by binary search in it."""
    digest, shard = table.column("digest").to_numpy(), table.column("shard").to_numpy()
    order = np.lexsort((digest, shard))
    known, twice = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    for run in np.split(digest[order], np.flatnonzero(np.diff(shard[order])) + 1):
        at = np.searchsorted(known, run)
        twice.append(run[known[np.minimum(at, len(known) - 1)] == run] if len(known) else run[:0])
        known = np.insert(known, at, run)
    twice = np.unique(np.concatenate(twice))
    at = np.searchsorted(twice, digest)
    hit = twice[np.minimum(at, len(twice) - 1)] == digest if len(twice) else np.zeros(len(digest), bool)
    return table.select(["node", "start", "end"]).filter(pa.array(hit))


def _packed(table: pa.Table) -> pa.Table:
    spans = node_spans(*(table.column(c).to_numpy() for c in ("node", "start", "end")))
    first = np.flatnonzero(np.concatenate(([True], np.diff(spans[:, 0]) != 0)))
    parts = np.split(np.ascontiguousarray(spans[:, 1:]), first[1:])
    return pa.table({"node": pa.array(spans[first, 0]), "spans": pa.array([x.tobytes() for x in parts], pa.binary())})


def _cut(body: str, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, count = [], []
            for text, packed in zip(batch.column(body), batch.column(gone), strict=True):
                data, at, parts = memoryview(text.as_buffer()), 0, []
                spans = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2).tolist()
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                count.append(len(spans))
            names = [c for c in batch.schema.names if c not in (body, gone)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], [*names, "_n_spans", "_kept"])

    return run


def _spans(long_: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """(node, spans: packed pairs of long) for each text of ``long_`` (id, node, text) with windows that repeat, but for
    those that repeat only because the whole text does."""
    buckets = 4 * shuffle_partitions(long_.sparkSession)
    rows = long_.select("node", "text").mapInArrow(_found(buckets), "bucket int, packed binary")
    found = staged(rows.groupBy("bucket").applyInArrow(_grouped, "kind int, gram long, node long, start long, end long, width long"), f"{path}/found")
    shards = F.ceil(F.col("width") / SHARD)
    todo = found.filter("kind > 0").withColumn("shard", F.pmod(F.xxhash64("node", "start"), shards).cast("int")).withColumn("split", shards > 1)
    parts = todo.groupBy("node").agg(F.collect_list(F.struct("gram", "shard", "start", "end", "kind", "split")).alias("parts")).join(nodes, "node").select("node", "first", "parts")
    texts = _holders(long_, parts)
    sliced = texts.join(parts.select("node", "parts"), "node").mapInArrow(_sliced, "node long, gram long, shard int, start long, kind int, split boolean, bytes binary")
    pairs = sliced.groupBy(F.pmod(F.xxhash64("gram", "shard"), F.lit(buckets)).alias("bucket")).applyInArrow(_compared, "node long, start long, end long, digest long, shard long")
    pairs = staged(pairs, f"{path}/compared")
    across = pairs.filter("digest is not null").groupBy(F.pmod("digest", F.lit(buckets)).alias("bucket")).applyInArrow(_merged, "node long, start long, end long")
    spans = found.filter("kind = 0").select("node", "start", "end").unionByName(pairs.filter("digest is null").select("node", "start", "end")).unionByName(across)
    return staged(spans.groupBy(F.pmod("node", F.lit(buckets)).alias("bucket")).applyInArrow(_packed, "node long, spans binary"), f"{path}/spans")


def _holders(long_: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, text) of the first row of each node in ``parts``."""
    wanted = parts.select(F.col("node").alias("_node"), F.col("first").alias("_first"))
    return long_.join(small_side(wanted), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_first")), "left_semi").select("node", "text")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans and _kept, the bytes that are left, in order.

    A text is its UTF-8 bytes, null none. Every copy of a text of SPAN bytes or more loses all of it; shorter texts stay.
    Strings are judged on the texts as given and do not cross rows; repeated rows are copies like any others, and so are
    rows with null ids. Columns of these names are replaced.
    """
    path = folder(docs.sparkSession)
    docs = docs.drop(*(c for c in ("_n_bytes", "_n_removed", "_n_spans", "_kept") if c not in (text, doc_id)))
    body, name, of, how, gone = private(docs, "body", "node", "of", "how", "spans")
    docs = docs.withColumn(body, text_bytes(text)).withColumn(name, F.when(F.octet_length(body) >= SPAN, F.xxhash64(body)))
    long_ = docs.filter(F.col(name).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(name).alias("node"), F.col(body).alias("text"))
    nodes = staged(long_.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")), f"{path}/nodes")
    spans = _spans(long_, nodes, path)
    copies = nodes.filter("copies > 1").select("node")
    kinds = copies.withColumn("how", F.lit(1)).unionByName(spans.join(copies, "node", "left_anti").select("node", F.lit(2).alias("how")))
    kinds = staged(kinds.select(F.col("node").alias(of), F.col("how").alias(how)), f"{path}/how")
    split = docs.join(small_side(kinds), F.col(name) == F.col(of), "left").drop(of).withColumn("_n_bytes", F.octet_length(body).cast("long"))
    whole, zero = F.col(how).isNotNull(), F.lit(0).cast("long")
    plain = split.filter(F.coalesce(how, F.lit(1)) == 1).withColumn("_n_spans", F.when(whole, 1).otherwise(zero).cast("long")).withColumn("_kept", F.when(whole, F.lit(b"")).otherwise(F.col(body))).drop(body, name, how)
    marked = split.filter(F.col(how) == 2).drop(how).join(spans.select(F.col("node").alias(name), F.col("spans").alias(gone)), name).drop(name)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in marked.schema if f.name not in (body, gone)]).add("_n_spans", "long").add("_kept", "binary")
    cut = marked.mapInArrow(_cut(body, gone), schema)
    return plain.unionByName(cut).withColumn("_n_removed", F.col("_n_bytes") - F.octet_length("_kept"))
