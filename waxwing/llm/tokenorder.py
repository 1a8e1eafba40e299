"""Token-ID output in training order: fixed-stride shards of a keyed permutation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkit import U, mix
from .tokens import END, VOCABULARY, encoded
from .work import folder, shuffle_partitions, small_side

#: Ids in a sequence, sequences in a shard, rounds of the permutation and its key.
LENGTH, PER_SHARD, ROUNDS, KEY = 2048, 1024, 6, 20240601
#: Ids in a part of the ordered stream.
PART_IDS = 1 << 25
_IDS = np.dtype("<u2")


def permuted(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..total-1: a balanced Feistel network on the next even power of two, walked along its
    cycle until it lands below ``total``."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << U(half) | right

    out = once(index.astype(U))
    while (out_ := np.flatnonzero(out >= U(total))).size:
        out[out_] = once(out[out_])
    return out.astype(np.int64)


def _encoded(vocabulary: str, end: int):
    """Each document's ids with an end id after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array([*encoded(text.as_py(), vocabulary), end], _IDS) for text in batch.column("text")]
            made = [batch.column("id"), batch.column("hash"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["id", "hash", "n", "tokens"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a part with its number and the ids before each row within it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = before + np.cumsum(batch.column("n").to_numpy(zero_copy_only=False))
        starts = np.concatenate(([before], ends[:-1])) if len(ends) else ends
        before = int(ends[-1]) if len(ends) else before
        made = [pa.array([part] * batch.num_rows, pa.int64()), pa.array(starts.astype(np.int64)), *(batch.column(c) for c in ("id", "n", "tokens"))]
        yield pa.RecordBatch.from_arrays(made, ["part", "within", "id", "n", "tokens"])


def _cut(length: int, total: int, key: int):
    """Pieces of sequences (slot, first id's place in the sequence): whole ones but where a task's rows begin, end or jump."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[int, list, bytes]] = []
        start, filled, inside, open_ = 0, 0, [], []

        def close() -> None:
            nonlocal start, filled, inside, open_
            if filled:
                pieces.append((start, inside, b"".join(open_)))
            start, filled, inside, open_ = start + filled, 0, [], []

        def rows() -> pa.RecordBatch:
            first = np.array([x[0] for x in pieces], np.int64)
            made = [pa.array(permuted(first // length, total, key)), pa.array((first % length).astype(np.int32)), pa.array([x[1] for x in pieces], pa.list_(pa.int64())), pa.array([x[2] for x in pieces], pa.binary())]
            pieces.clear()
            return pa.RecordBatch.from_arrays(made, ["slot", "at", "doc_ids", "tokens"])

        for batch in batches:
            for doc, place, tokens in zip(batch.column("id").to_pylist(), batch.column("place").to_pylist(), batch.column("tokens"), strict=True):
                if place != start + filled:
                    close()
                    start = place
                ids, done = np.frombuffer(tokens.as_buffer(), _IDS), 0
                while done < len(ids):
                    n = min(length - start % length - filled, len(ids) - done)
                    open_.append(ids[done : done + n].tobytes())
                    inside.append(doc)
                    filled, done = filled + n, done + n
                    if start % length + filled == length:
                        close()
                if len(pieces) >= 2048:
                    yield rows()
        close()
        if pieces:
            yield rows()

    return run


def _joined(length: int, end: int):
    """The pieces of each sequence, which follow each other, as one row; the corpus's last is filled up with end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int, list, bytes, int]] = []
        now, docs, parts = None, [], []

        def close() -> None:
            ids = b"".join(parts)
            n = len(ids) // _IDS.itemsize
            ids += np.full(length - n, end, _IDS).tobytes()
            made.append((now, n, docs, ids, zlib.crc32(ids)))

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            batch = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(batch, ["slot", "n_tokens", "doc_ids", "tokens", "crc32"])

        for batch in batches:
            for slot, ids, tokens in zip(batch.column("slot").to_pylist(), batch.column("doc_ids").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if slot != now:
                    if parts:
                        close()
                    now, docs, parts = slot, [], []
                docs = docs + ids if docs else ids
                parts.append(tokens)
                if len(made) >= 2048:
                    yield rows()
        if parts:
            close()
        if made:
            yield rows()

    return run


def in_training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, text: str = "text", doc_id: str = "doc_id", end: int = END) -> DataFrame:
    """(shard, slot, byte_offset, n_tokens, doc_ids, crc32, tokens): every sequence of the corpus at its global slot.

    The documents in the order of their ids (then of a hash of their texts), an end id after each, make one stream that is
    cut into sequences of ``length`` 16-bit ids; its last is filled up with end ids, which n_tokens leaves out. doc_ids are
    the documents that have ids in the sequence. Slots are a keyed permutation of the sequences' numbers, so the same
    documents and key give the same shards however the input is split and on whatever cluster. The result is
    partitioned by ranges of shards and ordered by slot: written as it is, each shard is a run of rows of one
    stride in the order in which they are read, from any slot on.

    Null and empty texts give an end id alone; repeated rows and null ids (which come first) are kept; an empty table gives
    no rows. Texts of one id and one hash count as equal.
    """
    spark = docs.sparkSession
    path = folder(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = texts.withColumn("hash", F.xxhash64("text")).mapInArrow(_encoded(vocabulary, end), "id long, hash long, n long, tokens binary")
    # Rows that repeat id and text may stand in any order; the salt lets many of them be in several parts.
    made = _written(made.withColumn("salt", F.monotonically_increasing_id()), f"{path}/encoded")
    ids = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = -(-ids // length)

    order = ["id", "hash", "salt"]
    parts = max(shuffle_partitions(spark), -(-ids // PART_IDS))
    ordered = made.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "tokens")
    ordered = _written(ordered.mapInArrow(_placed, "part long, within long, id long, n long, tokens binary"), f"{path}/ordered")
    # One row for each part: a bound that grows with parts, not rows.
    sizes = ordered.groupBy("part").agg(F.sum("n").alias("ids"))
    starts = sizes.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("start"))
    placed = ordered.join(small_side(starts), "part").select("id", (F.col("start") + F.col("within")).alias("place"), "tokens")

    pieces = placed.mapInArrow(_cut(length, total, key), "slot long, at int, doc_ids array<long>, tokens binary")
    # Slots are all numbers below the total, so ranges of shards are known without a sample.
    shards = max(1, -(-total // per_shard))
    ranges = min(shards, 16 * shuffle_partitions(spark))
    shard = F.floor(F.col("slot") / per_shard)
    dealt = pieces.repartitionById(ranges, F.floor(shard * ranges / shards).cast("int")).sortWithinPartitions("slot", "at")
    whole = dealt.mapInArrow(_joined(length, end), "slot long, n_tokens int, doc_ids array<long>, tokens binary, crc32 long")
    return whole.select(shard.alias("shard"), "slot", ((F.col("slot") % per_shard) * (length * _IDS.itemsize)).alias("byte_offset"), "n_tokens", "doc_ids", "crc32", "tokens")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Write an ``in_training_order`` result as raw files ``uri``/shard-N.bin and return (shard, sequences, bytes, path).

    ``uri`` is of any store that pyarrow opens. A shard is written by one task under another name, then moved into place:
    a rerun replaces it by the same bytes, and shards in place need no rewriting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        now, out, n = None, None, [0, 0]

        def close() -> pa.RecordBatch:
            out.close()
            path = f"{top}/shard-{now:08d}.bin"
            store.move(part, path)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([path])], ["shard", "sequences", "bytes", "path"])

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens"), strict=True):
                if shard != now:
                    if out:
                        yield close()
                    task = TaskContext.get()
                    part = f"{top}/.part-{shard}-{task.taskAttemptId()}"
                    now, out, n = shard, store.open_output_stream(part), [0, 0]
                data = tokens.as_buffer()
                out.write(data)
                n = [n[0] + 1, n[1] + data.size]
        if out:
            yield close()

    return ordered.select("shard", "tokens").mapInArrow(run, "shard long, sequences long, bytes long, path string")


def read_from(uri: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """``count`` sequences from a global slot on, by seeks into the raw shards: how a reader resumes."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(uri)
    out, stride = [], length * _IDS.itemsize
    while count > 0:
        n = min(count, per_shard - slot % per_shard)
        with store.open_input_file(f"{top}/shard-{slot // per_shard:08d}.bin") as file:
            file.seek(slot % per_shard * stride)
            data = file.read(n * stride)
        if not data:
            break
        out.append(np.frombuffer(data, _IDS).reshape(-1, length))
        slot, count = slot + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, length), _IDS)
