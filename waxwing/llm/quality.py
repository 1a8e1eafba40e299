"""Quality classifier: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import U, binary_chunks, mix, powers, prefix_hash, word_spans
from .work import private, small_side, text_bytes

#: Labelled rows that the model is fitted on, of each label: the bound of what is collected and broadcast.
SAMPLE = 1500
#: Terms: hashed trigrams of character shapes, word statistics, hashed trigrams of letters, hashed words; and the weight of
#: the latter two beside the former.
SHAPES, STATS, LETTERS, WORDS, LEXICAL = 1024, 64, 1024, 1024, 1.0
TERMS = SHAPES + STATS + LETTERS + WORDS
#: Latent dimensions, voting neighbours, power of the similarity that weighs a vote, and documents in a block of cosine
#: products.
LATENT, NEIGHBOURS, POWER, BLOCK = 48, 25, 4, 512
#: A row with at least this score is predicted to have label 1.
THRESHOLD = 0.3

_CLASS = np.full(256, 1, np.uint8)  # letters of other alphabets, as lower case
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[:33] = 4
_CLASS[10] = 5
for _i, _c in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
    _CLASS[_c] = 6 + _i
_TRIGRAM = (mix(np.arange(1 << 18, dtype=U)) % U(SHAPES)).astype(np.int32)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=U)


def _bin(share: float, bins: int) -> int:
    return min(bins - 1, int(share * bins))


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, counts of its terms) from the whole text: hashed trigrams of character classes; of the words how many equal the
    one before, how few are distinct and how long they are; hashed trigrams of bytes, A-Z as a-z; and hashed words."""
    for row, end, data, at in binary_chunks(column):
        kind = _CLASS[data].astype(np.int32)
        grams = _TRIGRAM[(kind[:-2] << 12) | (kind[1:-1] << 6) | kind[2:]] if len(kind) > 2 else np.zeros(0, np.int32)
        starts, ends = word_spans(data, at)
        low = _LOWER[data]
        letters = (((low[:-2] << U(16) | low[1:-1] << U(8) | low[2:]) * U(0x9E3779B97F4A7C15)) >> U(54)).astype(np.int32) if len(low) > 2 else np.zeros(0, np.int32)
        sums = prefix_hash(data, _TABLE)
        words = (sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts]
        cuts = np.searchsorted(starts, at)
        for i in range(end - row):
            a, b = int(at[i]), int(at[i + 1])
            out = np.zeros(TERMS, np.float32)
            if b - a > 2:
                out[:SHAPES] = np.bincount(grams[a : b - 2], minlength=SHAPES)
                out[SHAPES + STATS : TERMS - WORDS] = np.bincount(letters[a : b - 2], minlength=LETTERS)
            if n := int(cuts[i + 1] - cuts[i]):
                own = words[cuts[i] : cuts[i + 1]]
                out[TERMS - WORDS :] = np.bincount((mix(own) >> U(54)).astype(np.int32), minlength=WORDS)
                same = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
                few = 1 - len(np.unique(own)) / n
                long = float((ends[cuts[i] : cuts[i + 1]] - starts[cuts[i] : cuts[i + 1]]).mean())
                for base, k in ((0, _bin(same, 16)), (16, _bin(few, 16)), (32, _bin(min(long / 24, 0.99), 16))):
                    out[SHAPES + base + k] = n / 4
            yield row + i, out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms by log of count and idf; those of shape and those of letters and words have fixed shares of the unit norm."""
    x = np.log1p(counts) * idf
    for part, weight in ((slice(0, SHAPES + STATS), 1.0), (slice(SHAPES + STATS, TERMS), LEXICAL)):
        x[:, part] *= weight / np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-12)
    return x


@dataclass(frozen=True)
class Model:
    """Term weights, the projection to latent dimensions, and the labelled rows' unit vectors and labels."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.project
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Of each row the mean label of its nearest neighbours, weighted by a power of their cosine similarity."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** POWER + 1e-9
        score = (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), score, 0.5)


def fit_arrays(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Latent-semantic analysis of a bounded sample: tf-idf, then the leading right singular vectors."""
    n = len(labels)
    if not n:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), labels.astype(np.float64))
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = weighted(counts, idf)
    # Subspace iteration from a fixed start: the leading vectors without a decomposition of all terms.
    basis = np.random.Generator(np.random.PCG64(3)).standard_normal((TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(8):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, vectors = np.linalg.eigh((x @ basis).T.astype(np.float64) @ (x @ basis))
    project = np.ascontiguousarray(basis @ vectors[:, ::-1][:, :LATENT].astype(np.float32))
    model = Model(idf, project, np.zeros((0, LATENT), np.float32), labels.astype(np.float64))
    return Model(idf, project, np.ascontiguousarray(model.latent(counts)), labels.astype(np.float64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [x.tobytes() for _, x in term_counts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(counts, pa.binary())], ["id", "label", "counts"])


def held_out(doc_id: str = "doc_id"):
    """Whether the crc32 of the id as text is divisible by 5; such rows are never learned from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The model of at most ``sample`` labelled rows of each label, those with the least hashes of their ids."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    # Each label's rows are cut to the sample by a top-k, then joined: at most 2 * sample rows, of which the texts' counts.
    chosen = [known.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_bytes(text).alias("text")).join(small_side(chosen, 2 * sample), "id")
    counted = texts.select("id", "label", "text").mapInArrow(_counted, "id long, label int, counts binary")
    # Of rows that repeat an id with other texts, the one of the least hash of its terms.
    counted = counted.groupBy("id").agg(F.min_by(F.struct("label", "counts"), F.xxhash64("counts")).alias("x")).select("id", "x.label", "x.counts")
    rows = counted.orderBy("id").toArrow()
    counts = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in rows.column("counts")]) if rows.num_rows else np.zeros((0, TERMS), np.float32)
    return fit_arrays(counts, rows.column("label").to_numpy())


def _scored(model, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[np.ndarray] = []
            block: list[np.ndarray] = []
            for _, counts in term_counts(batch.column(body)):
                block.append(counts)
                if len(block) == BLOCK:
                    scores.append(model.value.scores(np.stack(block)))
                    block = []
            if block:
                scores.append(model.value.scores(np.stack(block)))
            score = np.concatenate(scores) if scores else np.zeros(0)
            names = [c for c in batch.schema.names if c != body]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.clip(score, 0.0, 1.0))], [*names, "_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with _score, from the whole text of each row alone.

    Empty and null texts score 0.5, as does every row if no labelled row is to be had. Repeated rows score alike. Labels
    other than 0 and 1 are ignored; of two labels for an id the larger counts. A column _score is replaced.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample, text, doc_id))
    docs = docs.drop("_score")
    (body,) = private(docs, "body")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("_score", T.DoubleType())])
    return docs.withColumn(body, text_bytes(text)).mapInArrow(_scored(model, body), schema)
