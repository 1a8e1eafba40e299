"""Fill-in-middle against a plain cut of each text."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from waxwing.llm import infilling


def plainly(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(text), form, a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_cuts_equal_plain_slices(spark):
    extra = [(9000 + i, t, "en", "a", 1, 7, 0, "h") for i, t in enumerate(["a<P>b", "<", "P><S", "é", "漢" * 70000, "a\0b\r\n", "x" * 1024, "😀é" * 1024, "<P" * 3000])]
    docs = spark.createDataFrame(corpus.rows() + extra, corpus.SCHEMA).repartition(3)
    out = infilling.with_restored(infilling.fill_in_middle(docs))
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(corpus.rows()) + len(extra)
    for r in rows:
        assert (r._n, r._form, r._prefix_chars, r._middle_chars, bytes(r._output).decode()) == plainly(r.doc_id, r.text)
        assert bytes(r._restored).decode() == (r.text or "")
    assert {r._form for r in rows} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(corpus.nothing(spark)).collect() == []


@pytest.mark.parametrize("every", [1, 3, 64, 5000])
def test_cut_at_any_unit(every):
    pick = random.Random(every)
    text = "".join(pick.choice("aé漢😀 \n") for _ in range(3000))
    data = text.encode()
    index = infilling.point_index(data, every)
    assert index.units == len(text) and len(index.bytes) == -(-len(text) // every)
    for k in (*range(0, 200), 2999, 3000):
        assert infilling.cut_at(data, index, k) == (len(text[:k].encode()), k)
    word = re.compile(r"\S+")
    index, starts = infilling.pattern_index(data, word, every), [m.start() for m in word.finditer(text)]
    assert index.units == len(starts)
    for k in (*range(1, min(300, len(starts))), len(starts)):
        point = starts[k] if k < len(starts) else len(text)
        assert infilling.cut_at(data, index, k, word) == (len(text[:point].encode()), point)


def test_long_words_as_units(spark):
    text = "a" * 5000 + " " + "b" * 9000 + "  cé" * 3000
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(50, "   "), (51, None)], "doc_id long, text string")
    rows = infilling.with_restored(infilling.fill_in_middle(docs, unit=r"\S+", every=7)).collect()
    starts = [0, *(m.start() for m in re.finditer(r"\S+", text))][1:]
    for r in rows:
        assert bytes(r._restored).decode() == (r.text or "")
        if r.doc_id < 30 and r._form != "plain":
            assert r._n == 3002 and r._prefix_chars in {0, len(text), *starts}


def test_columns_of_clashing_names(spark):
    docs = corpus.documents(spark).withColumns({c: F.lit("mine") for c in ("_n", "_form", "_output", "data", "h1", "n", "form")})
    out = infilling.with_restored(infilling.fill_in_middle(docs), "_output_", "_form_")
    rows = out.collect()
    assert all(r._n == r._form == r._output == r.data == r.h1 == "mine" and bytes(r._restored).decode() == (r.text or "") for r in rows)
