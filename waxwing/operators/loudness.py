"""Integrated loudness by ITU-R BS.1770: frequency weighting carried over chunks of samples, then gating in two passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the standard, as the analogue prototypes behind its coefficients: the shelf's corner, gain and quality,
#: the exponent of its gain at the corner, and the high-pass's corner and quality.
SHELF_HZ, SHELF_DB, SHELF_Q, SHELF_POWER = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773
#: Fixed values of the standard: what a full-scale mean square is worth, the absolute gate, how far the relative one lies
#: below, tenths of a second in a block and between blocks, and the channels' weights (left, right, centre, two surrounds).
OFFSET, ABSOLUTE, RELATIVE, BLOCK = -0.691, -70.0, -10.0, 4
WEIGHTS = (1.0, 1.0, 1.0, 1.41, 1.41)
SILENCE = -100.0
#: Samples filtered by one product of matrices, chunks of a batch that are filtered together, and what is left of a state
#: that no longer matters.
STRIDE, ROWS, NOTHING = 256, 64, 1e-18


def shelf(rate: float) -> tuple[list[float], list[float]]:
    k, high = math.tan(math.pi * SHELF_HZ / rate), 10 ** (SHELF_DB / 20)
    middle, unit = high**SHELF_POWER, 1 + k / SHELF_Q + k * k
    b = [high + middle * k / SHELF_Q + k * k, 2 * (k * k - high), high - middle * k / SHELF_Q + k * k]
    return [x / unit for x in b], [2 * (k * k - 1) / unit, (1 - k / SHELF_Q + k * k) / unit]


def high_pass(rate: float) -> tuple[list[float], list[float]]:
    k = math.tan(math.pi * PASS_HZ / rate)
    unit = 1 + k / PASS_Q + k * k
    return [1.0, -2.0, 1.0], [2 * (k * k - 1) / unit, (1 - k / PASS_Q + k * k) / unit]


@dataclass(frozen=True)
class Weighting:
    """Both filters as one linear system of four state values: s' = step s + take x, y = give s + through x."""

    step: np.ndarray
    take: np.ndarray
    give: np.ndarray
    through: float

    @classmethod
    def at(cls, rate: float) -> Weighting:
        parts = []
        for b, a in (shelf(rate), high_pass(rate)):
            parts.append((np.array([[-a[0], 1.0], [-a[1], 0.0]]), np.array([b[1] - a[0] * b[0], b[2] - a[1] * b[0]]), np.array([1.0, 0.0]), b[0]))
        (s1, t1, g1, d1), (s2, t2, g2, d2) = parts
        step = np.block([[s1, np.zeros((2, 2))], [np.outer(t2, g1), s2]])
        return cls(step, np.concatenate((t1, t2 * d1)), np.concatenate((d2 * g1, g2)), d1 * d2)

    def strides(self, size: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``size`` samples give: outputs of a unit sample (Toeplitz), outputs of a state, and the state of each sample."""
        states, given, power = [], [], np.eye(4)
        for _ in range(size):
            given.append(self.give @ power)
            states.append(power @ self.take)
            power = self.step @ power
        given, states = np.array(given), np.array(states)
        answer = np.concatenate(([self.through], given[:-1] @ self.take))
        lag = np.arange(size)[None, :] - np.arange(size)[:, None]
        return np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0), given.T, states[::-1]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, last states) of rows of samples from rows of states."""
        toeplitz, given, states = self.strides()
        out, powers = np.empty_like(x), {}
        for low in range(0, x.shape[1], STRIDE):
            part = x[:, low : low + STRIDE]
            n = part.shape[1]
            out[:, low : low + n] = part @ toeplitz[:n, :n] + state @ given[:, :n]
            if n not in powers:
                powers[n] = np.linalg.matrix_power(self.step, n).T
            state = state @ powers[n] + part @ states[STRIDE - n :]
        return out, state


def _samples(column: pa.Array) -> list[np.ndarray]:
    """Samples of -1 to 1 from lists of numbers, or from bytes: 16 bits signed, little-endian."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [np.frombuffer(x[: len(x) // 2 * 2], "<i2") / 32768.0 for x in column.to_pylist()]
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for line, x in zip(out, rows, strict=True):
        line[: len(x)] = x
    return out


def _ends(weighting: Weighting, length: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each full chunk ends in if it begins in none."""
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                rows = _samples(part.column("samples"))
                if any(len(x) > length for x in rows):
                    raise ValueError(f"a chunk of more than {length} samples")
                last = weighting.run(_padded([x if len(x) == length else np.zeros(length) for x in rows]), np.zeros((len(rows), 4)))[1]
                yield pa.RecordBatch.from_arrays([*part.select(["track", "channel", "chunk"]).columns, pa.array(list(last), pa.list_(pa.float64())), pa.array([len(x) == length for x in rows])], ["track", "channel", "chunk", "own", "full"])

    return run


def _energies(weighting: Weighting, length: int, hop: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of squares, and the samples, of each tenth of a second of the weighted signal."""
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part = frame.slice(at, ROWS)
                rows = _samples(part.column("samples"))
                state = np.array(part.column("state").to_pylist(), float).reshape(-1, 4)
                squares = weighting.run(_padded(rows), state)[0] ** 2
                size = np.array([len(x) for x in rows])
                counts = np.minimum(np.maximum(size[:, None] - np.arange(0, length, hop), 0), hop)
                row, tenth = np.nonzero(counts)
                sums = [squares[r, t * hop : t * hop + counts[r, t]].sum() for r, t in zip(row.tolist(), tenth.tolist(), strict=True)]
                place = part.column("chunk").to_numpy()[row] * (length // hop) + tenth
                yield pa.RecordBatch.from_arrays([part.column("track").take(pa.array(row)), part.column("channel").take(pa.array(row)), pa.array(place), pa.array(sums, pa.float64()), pa.array(counts[row, tenth])], ["track", "channel", "tenth", "energy", "n"])

    return run


def integrated_loudness(chunks: DataFrame, rate: int, length: int) -> DataFrame:
    """(track, lufs) from chunks of samples (track, channel, chunk, samples), numbered from 0 without gaps.

    ``samples`` are numbers of -1 to 1 or bytes of 16 bits, ``length`` of them in each chunk but a channel's last;
    ``length`` is a multiple of a tenth of a second, ``rate // 10``. Channels count from 0 in the standard's order.
    The filters' state is carried from chunk to chunk: the state that a chunk begins in is a sum over the chunks before it, of
    which all terms are taken that a double can hold beside the first. So chunks are filtered in parallel, and no task holds
    a track. Blocks of 0.4 s, one every 0.1 s, count if they are above -70 LUFS and at most 10 LU below the mean of those.
    A track shorter than a block is one block; silence, and a track without samples, is -100. A chunk without samples is
    empty; a null chunk number goes.
    """
    hop = rate // 10
    if length <= 0 or hop <= 0 or length % hop:
        raise ValueError("a chunk must hold whole tenths of a second")
    weighting = Weighting.at(rate)
    kind = dict(chunks.dtypes)
    empty = F.lit(b"") if kind["samples"] == "binary" else F.array().cast(kind["samples"])
    rows = chunks.select("track", F.col("channel").cast("int").alias("channel"), F.col("chunk").cast("long").alias("chunk"), F.coalesce("samples", empty).alias("samples")).filter("chunk is not null")
    ends = rows.mapInArrow(_ends(weighting, length), f"track {kind['track']}, channel int, chunk long, own array<double>, full boolean")
    far, terms = np.linalg.matrix_power(weighting.step, length), [np.eye(4)]
    while np.abs(terms[-1] @ far).max() > NOTHING:
        terms.append(terms[-1] @ far)
    line = W.partitionBy("track", "channel").orderBy("chunk")
    before = [F.lag("own", j + 1).over(line) for j in range(len(terms))]
    state = F.array(*(sum((F.coalesce(b[m], F.lit(0.0)) * float(term[i, m]) for b, term in zip(before, terms, strict=True) for m in range(4)), F.lit(0.0)) for i in range(4)))
    begun = ends.withColumn("state", state).withColumn("bad", ~F.lead("chunk").over(line).isNull() & ~F.col("full") | (F.row_number().over(line) - 1 != F.col("chunk")))
    begun = begun.select(F.col("track").alias("t"), F.col("channel").alias("c"), F.col("chunk").alias("k"), F.when(F.col("bad"), F.raise_error(F.lit("chunks must be full but for the last, and numbered without gaps")).cast("array<double>")).otherwise(F.col("state")).alias("state"))
    joined = rows.join(begun, rows["track"].eqNullSafe(begun["t"]) & rows["channel"].eqNullSafe(begun["c"]) & (rows["chunk"] == begun["k"])).drop("t", "c", "k")
    tenths = joined.mapInArrow(_energies(weighting, length, hop), f"track {kind['track']}, channel int, tenth long, energy double, n long")
    weight = F.coalesce(F.get(F.array(*map(F.lit, WEIGHTS)), F.col("channel")), F.lit(0.0))
    tenths = tenths.groupBy("track", "tenth").agg(F.sum(F.col("energy") * weight).alias("energy"), F.max("n").alias("n"))
    ahead = W.partitionBy("track").orderBy("tenth").rowsBetween(0, BLOCK - 1)
    whole = W.partitionBy("track")
    loud = lambda power: F.when(power > 0, F.log10(power) * 10 + OFFSET)
    blocks = tenths.withColumn("sum", F.sum("energy").over(ahead)).withColumn("held", F.sum("n").over(ahead))
    blocks = blocks.withColumn("all", F.sum("energy").over(whole)).withColumn("length", F.sum("n").over(whole))
    short = (F.col("length") < BLOCK * hop) & (F.col("tenth") == 0)
    power = F.when(F.col("held") == BLOCK * hop, F.col("sum") / (BLOCK * hop)).when(short, F.col("all") / F.col("length"))
    blocks = blocks.select("track", power.alias("power"), (F.col("length") < BLOCK * hop).alias("short"))
    gate = F.avg(F.when(loud(F.col("power")) > ABSOLUTE, F.col("power"))).over(whole)
    above = (loud(F.col("power")) > ABSOLUTE) & (loud(F.col("power")) > loud(gate) + RELATIVE)
    means = blocks.select("track", F.when(above | F.col("short"), F.col("power")).alias("power")).groupBy("track").agg(F.avg("power").alias("power"))
    every = chunks.select("track").distinct().withColumnRenamed("track", "t")
    told = every.join(means, every["t"].eqNullSafe(means["track"]), "left")
    return told.select(F.col("t").alias("track"), F.coalesce(F.round(loud(F.col("power")), 2), F.lit(SILENCE)).alias("lufs"))
