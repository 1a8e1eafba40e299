"""Fill-in-middle: texts cut into prefix, middle and suffix at units found through a sparse checkpoint index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import private, text_bytes

#: Units between two checkpoints, and bytes that one counting step looks at.
EVERY, WINDOW = 1024, 1 << 16
#: The marks before prefix, suffix and middle; documents of a hundred that stay plain, and of those cut the
#: ones of a hundred with the suffix first.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of output after which a task hands a batch on.
BATCH = 1 << 24


@dataclass(frozen=True)
class Index:
    """Of one text: its number of units, and the unit, byte and code-point offset of each checkpoint."""

    units: int
    at: np.ndarray
    bytes: np.ndarray
    points: np.ndarray


def point_index(data: bytes, every: int = EVERY) -> Index:
    """The index of a text whose units are code points, counted window by window."""
    flat = np.frombuffer(data, np.uint8)
    units, found = 0, [np.zeros(0, np.int64)]
    for low in range(0, len(flat), WINDOW):
        starts = np.flatnonzero((flat[low : low + WINDOW] & 0xC0) != 0x80)
        found.append(starts[-units % every :: every] + low)
        units += len(starts)
    offsets = np.concatenate(found)
    at = np.arange(len(offsets), dtype=np.int64) * every
    return Index(units, at, offsets, at)


def pattern_index(data: bytes, pattern: re.Pattern, every: int = EVERY) -> Index:
    """The index of a text whose units are the matches of a pattern; what lies between two matches goes with the first."""
    text, marks, units, byte, point = data.decode("utf-8"), [], 0, 0, 0
    for match in pattern.finditer(text):
        if units % every == 0:
            byte, point = byte + len(text[point : match.start()].encode("utf-8")), match.start()
            marks.append((units, byte, point))
        units += 1
    table = np.array(marks, np.int64).reshape(-1, 3)
    return Index(units, table[:, 0], table[:, 1], table[:, 2])


def indexed(data: bytes, unit: re.Pattern | None = None, every: int = EVERY) -> Index:
    return point_index(data, every) if unit is None else pattern_index(data, unit, every)


def cut_at(data: bytes, index: Index, unit_number: int, unit: re.Pattern | None = None) -> tuple[int, int]:
    """(byte, code-point offset) of a unit's start, the text's end for one past the last; unit 0 starts with the text.

    The last checkpoint before the unit is found by binary search, and only what follows it is scanned.
    """
    if unit_number <= 0:
        return 0, 0
    near = int(np.searchsorted(index.at, min(unit_number, index.units), "right")) - 1
    byte, point = (int(index.bytes[near]), int(index.points[near])) if near >= 0 else (0, 0)
    past = unit_number - (int(index.at[near]) if near >= 0 else 0)
    if unit_number >= index.units:
        return len(data), point + int(np.count_nonzero((np.frombuffer(data, np.uint8)[byte:] & 0xC0) != 0x80))
    if unit is None:
        # A code point has at most four bytes.
        starts = np.flatnonzero((np.frombuffer(data, np.uint8)[byte : byte + 4 * past + 4] & 0xC0) != 0x80)
        return byte + int(starts[past]), point + past
    # Decoded piece by piece, so that a cut near a checkpoint doesn't cost the rest of a long text.
    size = 256 * (past + 1)
    while True:
        end = byte + size
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        text, whole = data[byte:end].decode("utf-8"), end >= len(data)
        for i, match in enumerate(unit.finditer(text)):
            # A match that touches the end of the piece may go on in the next.
            if not whole and match.end() == len(text):
                break
            if i == past:
                return byte + len(text[: match.start()].encode("utf-8")), point + match.start()
        size *= 4


def draws(doc_id: Column, epoch: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``epoch:doc_id``; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


#: What is added, as Spark and Arrow call its types.
_ADDED = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.BinaryType(), pa.binary())]


def rearranged(data: bytes, chance: tuple[int, int, int, int], unit: re.Pattern | None, every: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    index = indexed(data, unit, every)
    marks = [m.encode() for m in MARKS]
    if not data or any(m in data for m in marks) or chance[2] % 100 >= 100 - PLAIN:
        return index.units, "plain", None, None, data
    low, high = sorted(h % (index.units + 1) for h in chance[:2])
    (a, first), (b, second) = cut_at(data, index, low, unit), cut_at(data, index, high, unit)
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    parts = [suffix, prefix, middle] if chance[3] % 100 < SUFFIX_FIRST else [prefix, suffix, middle]
    return index.units, "spm" if parts[0] is suffix else "psm", first, second - first, b"".join(parts)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of: parts lie between the marks, none of which a cut text holds itself."""
    if form == "plain":
        return output
    at = {m: output.index(m.encode()) for m in MARKS}
    order = sorted(at, key=at.get)
    ends = [at[m] for m in order[1:]] + [len(output)]
    part = {m: output[at[m] + len(m) : end] for m, end in zip(order, ends, strict=True)}
    return part["<P>"] + part["<M>"] + part["<S>"]


def _batches(frames: Iterator[pa.RecordBatch], make, fields: list[pa.Field], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of ``names`` beside what ``make`` gives for each row, in batches of bounded bytes."""
    for frame in frames:
        rows, size, first = [], 0, 0
        for i in range(frame.num_rows):
            row = make(frame, i)
            rows.append(row)
            size += len(row[-1])
            if size >= BATCH or i + 1 == frame.num_rows:
                kept = frame.select(names).slice(first, i + 1 - first)
                made = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*names, *(f.name for f in fields)])
                rows, size, first = [], 0, i + 1


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str | None = None, every: int = EVERY, epoch: int = 1) -> DataFrame:
    """All rows and columns with ``_n``, ``_form``, ``_prefix_chars``, ``_middle_chars`` and ``_output`` (bytes of UTF-8).

    Units are code points, or the matches of the pattern ``unit`` (words, say), which must not depend on what lies before
    a match. Cuts and form follow from the id and ``epoch`` alone. A null text is empty; empty texts and those that hold a
    mark stay plain, with null counts; a null id draws as one without digits; rows that repeat give the same rows again;
    an empty table gives none. Other columns are kept; if one is called like one of these, ours has underscores after it.
    Texts are cut one at a time where they lie: no shuffle, and memory for a batch of rows.
    """
    made = private(docs, *(f"_{name}" for name, *_ in _ADDED))
    data, *chances = private(docs, "data", "h1", "h2", "h3", "h4")
    names, pattern = docs.columns, re.compile(unit) if unit else None
    given = docs.withColumns({data: text_bytes(text)} | dict(zip(chances, draws(F.col(doc_id), epoch), strict=True)))
    fields = [pa.field(n, arrow) for n, (_, _, arrow) in zip(made, _ADDED, strict=True)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(frame: pa.RecordBatch, i: int) -> tuple:
            chance = tuple(frame.column(c)[i].as_py() for c in chances)
            return rearranged(frame.column(data)[i].as_py(), chance, pattern, every)

        yield from _batches(frames, make, fields, names)

    shape = T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, (_, kind, _) in zip(made, _ADDED, strict=True))])
    return given.mapInArrow(run, shape)


def with_restored(cut: DataFrame, output: str = "_output", form: str = "_form") -> DataFrame:
    """All rows with ``_restored``, the bytes of the text that each output was made of; a null output gives none."""
    (made,) = private(cut, "_restored")
    names = cut.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(frame: pa.RecordBatch, i: int) -> tuple:
            return (restored(frame.column(output)[i].as_py() or b"", frame.column(form)[i].as_py() or "plain"),)

        yield from _batches(frames, make, [pa.field(made, pa.binary())], names)

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField(made, T.BinaryType())]))


#: The contract's rows as DuckDB SQL.
SQL = """
WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM given),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM drawn),
parts AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
