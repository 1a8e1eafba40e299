"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from waxwing.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def all_scores(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for doc_id, c in held:
            n, score = sum(c.values()), 0
            for t, repeats in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += repeats * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank + 1, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scores)[:k])]
    return out


def items():
    pick = random.Random(8)
    words = [f"w{i}" for i in range(420)]
    made = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(1, 60)))) for i in range(25)]
    made += [(30, None), (31, ""), (32, "nothing-known 漢字"), (33, "W1 w1 w1 W2"), (34, "é"), (35, "É"), (36, "ONE one two 2"), (None, "w7 w8"), (37, "ab " * 3000)]
    return made


@pytest.mark.parametrize(("block", "documents", "cells"), [(1 << 22, 4096, 1 << 22), (4000, 3, 90), (1, 1, 1)])
def test_equal_to_all_scores(spark, monkeypatch, block, documents, cells):
    for name, value in (("BLOCK", block), ("DOCUMENTS", documents), ("CELLS", cells)):
        monkeypatch.setattr(lexical, name, value)
    docs = [(r[0], r[1]) for r in corpus.rows()]
    given = items()
    table = corpus.documents(spark).withColumns({c: F.lit("mine") for c in ("id", "data", "block", "term", "score", "rank")})
    asked = spark.createDataFrame([*given, given[3]], "item_id long, text string")
    found = [tuple(r) for r in lexical.ranked(table, asked).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = all_scores(docs, given)
    assert sorted(found, key=key) == sorted(wanted, key=key) and len(wanted) > 200


def test_rounds_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 6)
    asked = spark.createDataFrame(items(), "item_id long, text string")
    found = {tuple(r) for r in lexical.ranked(corpus.documents(spark), asked, 3).collect()}
    assert found == set(all_scores([(r[0], r[1]) for r in corpus.rows()], items(), 3))


def test_common_text_and_empty_tables(spark):
    """Hundreds of equal documents tie at the kth bound; all are scored and the smallest ids win."""
    docs = [(i, "the same words again") for i in range(700)] + [(900 + i, f"the word {i}") for i in range(50)]
    asked = [(1, "same words"), (2, "the"), (3, "unknown")]
    table, questions = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(asked, "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.ranked(table, questions).collect()) == all_scores(docs, asked)
    for one, two in ((corpus.nothing(spark), questions), (table, questions.limit(0))):
        assert lexical.ranked(one, two).collect() == []


def test_bytes_bound_impacts():
    impacts = np.concatenate((np.arange(0, 9000), np.random.Generator(np.random.PCG64(4)).integers(0, 1_000_001, 20000)))
    levels = lexical.upward(impacts)
    assert (lexical._lower(levels) <= impacts).all() and (impacts <= lexical._upper(levels)).all()
    assert (lexical._upper(levels) - lexical._lower(levels) <= lexical.MOST // lexical.STEPS + 1).all()


def test_blocks_hold_whole_texts():
    import pyarrow as pa

    texts = [b"", b"One two", b"x" * 50, "é漢 A-b".encode(), b"", b"last"]
    frame = pa.RecordBatch.from_pydict({"data": pa.array(texts, pa.binary())})
    size = np.array([len(t) for t in texts])
    parts = list(lexical._slices(frame, size))
    assert sum(len(p) for p in parts) == 6
    found, rows = lexical.terms_of(frame.column(0).slice(1, 4))
    assert [t.decode() for t in found.to_pylist()] == ["one", "two", "x" * 50, "é漢", "a", "b"] and rows.tolist() == [0, 0, 1, 2, 2, 2]
