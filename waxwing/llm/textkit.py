"""Vectorised word and shingle hashing over Arrow binary columns, used inside tasks.

Words are the runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. All hashes are 64 bits and the same on
every machine. Work goes in chunks of whole documents, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 19
U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, dtype=U)[_LOWER]
_PLACE = np.random.Generator(np.random.PCG64(20240502)).integers(0, 1 << 64, 64, dtype=U) | U(1)
_powers = (np.ones(1, U), np.ones(1, U))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of the rolling hash and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(max(n, CHUNK + 1), base, U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = tuple(made)
    return _powers


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = the sum over i..j-1 of table[byte] * base**place; times inverse**i it hashes data[i:j]."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def binary_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, offsets within them) for runs of rows of about CHUNK bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses a document boundary in ``at``."""
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingle hashes in ascending order); a shorter text's whole sequence is its one shingle."""
    for row, end, data, at in binary_chunks(column):
        starts, ends = word_spans(data, at)
        sums = prefix_hash(data, _BYTE)
        words = mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(U) * _PLACE[63])
        cuts = np.searchsorted(starts, at)
        if len(words) >= width:
            grams = words[: len(words) - width + 1] * _PLACE[0]
            for i in range(1, width):
                grams = grams + words[i : len(words) - width + 1 + i] * _PLACE[i]
            grams = mix(grams)
        for r, a, b in zip(range(row, end), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= width:
                yield r, np.unique(grams[a : b - width + 1])
            elif b > a:
                yield r, mix((words[a:b] * _PLACE[32 : 32 + b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield r, np.zeros(0, U)
