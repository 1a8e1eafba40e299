"""Token counts by a separator scan of flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import END, VOCABULARY, encoded
from .work import folder

#: Ids in a block of a flat file.
BLOCK = 1 << 20
_IDS = np.dtype("<u2")


def _flat(vocabulary: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, first = TaskContext.get().partitionId(), 0, 0
        rest: list[np.ndarray] = []
        held = 0

        def rows(payload: bytes | None, ids: pa.Array | None, number: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids.to_pylist() if ids is not None else None], pa.list_(pa.int64()))], ["file", "number", "payload", "ids"])

        for batch in batches:
            for text in batch.column("text"):
                rest.append(np.array([*encoded(text.as_py(), vocabulary), end], _IDS))
                held += len(rest[-1])
                if held >= block:
                    whole = np.concatenate(rest)
                    for at in range(0, held - block + 1, block):
                        yield rows(whole[at : at + block].tobytes(), None, number)
                        number += 1
                    rest = [whole[held - held % block :]]
                    held %= block
            yield rows(None, batch.column("id"), first)
            first += batch.num_rows
        if held:
            yield rows(np.concatenate(rest).tobytes(), None, number)

    return run


def write_flat(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id", end: int = END, block: int = BLOCK) -> DataFrame:
    """Write the documents as flat files of 16-bit ids, an end-of-document id after each, and return them as rows.

    A file is a partition's stream cut into blocks of equal size anywhere: (file, number, payload). Rows with ``ids``
    instead list the ids of a file's documents in order, from document ``number`` on; the stream itself has no index.
    """
    made = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_flat(vocabulary, end, block), "file long, number long, payload binary, ids array<long>")
    made.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def read_flat(spark, path: str, block: int = BLOCK) -> DataFrame:
    """Raw flat files under ``path`` as blocks (file, number, payload); each file must fit a task's memory."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                data = data.as_py()
                parts = [data[at : at + 2 * block] for at in range(0, len(data), 2 * block)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["file", "number", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, number long, payload binary")


def _scan(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, inner, tail, ends = [], [], [], []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), _IDS)
                at = np.flatnonzero(ids == end)
                head.append(int(at[0]) if len(at) else len(ids))
                inner.append((np.diff(at) - 1).astype(np.int64))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else 0)
                ends.append(len(at))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("number"), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64()), pa.array(ends, pa.int64())], ["file", "number", "head", "inner", "tail", "ends"])

    return run


def counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens) for each document of flat files given as blocks (file, number, payload).

    Each block is searched for the end id by itself: what lies before its first end, between its ends and after its
    last. A prefix scan over a file's blocks then carries on the count of ends and the ids since the last end. Ids after
    a file's last end are a document of their own. A payload that is null or empty changes nothing.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    scanned = blocks.filter(F.length("payload") > 0).select("file", "number", "payload").mapInArrow(_scan(end), f"file {kind}, number long, head long, inner array<long>, tail long, ends long")
    order = W.partitionBy("file").orderBy("number")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    stitched = scanned.withColumn("first", F.coalesce(F.sum("ends").over(before), zero))
    # Ids since the last end before a block: the tail of the last block with an end, and the heads of those after it.
    since = stitched.withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(order))
    since = since.withColumn("open", F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("head")))
    since = since.withColumn("sofar", F.sum("open").over(W.partitionBy("file", "run").orderBy("number")))
    carried = since.withColumn("carry", F.coalesce(F.lag("sofar").over(order), zero)).withColumn("last", F.lead("number").over(order).isNull())
    done = carried.filter("ends > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), "inner")).alias("at", "n_tokens"))
    left = carried.filter("last and sofar > 0").select("file", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("sofar").alias("n_tokens"))
    return done.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens").unionByName(left)


def document_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``, through flat files in the shared folder.

    Null and empty texts have 0 tokens; repeated rows and null ids come back one by one.
    """
    flat = write_flat(docs, f"{folder(docs.sparkSession)}/flat", vocabulary, text, doc_id, block=block)
    named = flat.filter("ids is not null").select("file", "number", F.posexplode("ids").alias("at", "doc_id")).select("file", (F.col("number") + F.col("at")).alias("ordinal"), "doc_id")
    return named.join(counts(flat.filter("payload is not null")), ["file", "ordinal"]).select("doc_id", "n_tokens")
