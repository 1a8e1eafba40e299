"""Suffix arrays, lines, decontamination and the classifier, each against brute force or planted cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from waxwing.llm import decontamination, lines, quality, suffixes


def repeats(texts: list[str | None]) -> list[tuple]:
    """(bytes, removed, spans, what is left) of each text by all its windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def spans_of(df) -> Counter:
    return Counter((r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) for r in df.collect())


@pytest.mark.parametrize("shard", [2048, 3])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    texts = [r[1] for r in corpus.rows()]
    assert spans_of(suffixes.without_repeats(corpus.documents(spark))) == Counter(repeats(texts))


def test_repeats_at_edges_and_within_one_text(spark):
    pick = random.Random(9)
    text = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    a, b = text(199), text(200)
    texts = [a, a + "1", b, "x" + b + "y", text(150) + b[:199], text(300) * 2, "é" * 150 + b + "é" * 150, "ab" * 300, "ab" * 101, text(700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert spans_of(suffixes.without_repeats(docs)) == Counter(repeats(texts))
    assert suffixes.without_repeats(corpus.nothing(spark)).collect() == []


def test_suffix_array_and_common_prefixes():
    pick = random.Random(4)
    for _ in range(30):
        parts = ["".join(pick.choice("ab") for _ in range(pick.randrange(1, 60))).encode() for _ in range(pick.randrange(1, 8))]
        size = np.array([len(x) for x in parts])
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        data = np.frombuffer(b"".join(parts), np.uint8)
        left = np.repeat(begin + size, size) - np.arange(len(data))
        tails = [data[i : i + left[i]].tobytes() for i in range(len(data))]
        order = suffixes.suffix_array(data, left)
        assert [tails[i] for i in order] == sorted(tails)
        common = suffixes.common_prefixes(data, left, begin, order)
        for x, y in zip(order, order[1:], strict=False):
            same = next((k for k, (p, q) in enumerate(zip(tails[x], tails[y], strict=False)) if p != q), min(len(tails[x]), len(tails[y])))
            assert common[y] == min(same, suffixes.SPAN)


def test_line_dedup_removes_aligned_blocks_from_the_later_document(spark):
    a, b, c = "first line of the story", "second line of the story", "third line of the story"
    texts = {1: f"{a}\n{b}\nown one", 2: f"intro two\n{a}\n{b}\nend two", 3: f"{b}\n{a}", 5: f"{c}\nshort\nx", 6: f"{c}\nshort\nx", 7: "", 8: None, 9: "\n\n", 10: f"x\n{'y' * 90000}\n{c}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id: (r._kept, r._n_lines, len(r._removed)) for r in lines.deduplicated(docs).collect()}
    assert kept[1] == (texts[1], 3, 0) and kept[2] == ("intro two\nend two", 4, 2)
    assert kept[3][2] == 1 and kept[5] == (texts[5], 3, 0) and kept[6] == ("", 3, 3)
    assert kept[7] == ("", 1, 0) and kept[8] == ("", 1, 0) and kept[10] == (f"x\n{'y' * 90000}", 3, 1)
    assert lines.deduplicated(corpus.documents(spark)).count() == len(corpus.rows())
    assert lines.deduplicated(corpus.nothing(spark)).collect() == []


def test_line_dedup_equals_aligning_all_pairs(spark):
    pick = random.Random(12)
    common = ["", "}", "short", "  ", *(f"a line that many documents hold, number {i}" for i in range(6)), *(f"tiny {i}" for i in range(4))]
    texts = {}
    for i in range(120):
        held = [pick.choice(common) if pick.random() < 0.6 else f"own {i} {pick.randrange(9**9)}" for _ in range(pick.randrange(1, 12))]
        texts[i] = "\n".join(held)
    # A rare line and, out of its holder's reach, a passage that many hold; two passages of different first holders.
    texts |= {200 + i: f"a passage that many hold\nown {i}" for i in range(20)} | {230 + i: f"another passage of many\nown {i}x" for i in range(20)}
    texts |= {300: "a line that only two hold\nx", 301: "a line that only two hold\ny\na passage that many hold\nz\nanother passage of many"}
    texts |= {302: "a passage that many hold\nown 302"}
    number: dict[str, int] = {}
    listed = {k: [number.setdefault(x.rstrip(" "), len(number)) for x in t.split("\n")] for k, t in texts.items()}
    sizes = {k: [len(x.strip(" ")) for x in t.split("\n")] for k, t in texts.items()}
    expected, first = {}, {}
    for k in sorted(texts):
        gone = {j for e in texts if e < k and texts[e] != texts[k] for j in lines.common_lines(listed[e], listed[k], sizes[k])}
        copy = texts[k] in first and sum(sizes[k]) >= lines.LEAST
        # Copies share one result; all lines of a later one go.
        expected[k] = list(range(len(sizes[k]))) if copy else expected[first[texts[k]]] if texts[k] in first else sorted(gone)
        first.setdefault(texts[k], k)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    assert {r.doc_id: list(r._removed) for r in lines.deduplicated(docs).collect()} == expected
    assert expected[301] == [0, 2, 4]


def test_patience_alignment_is_common_and_ascending():
    pick = random.Random(8)
    for _ in range(200):
        a, b = ([pick.randrange(12) for _ in range(pick.randrange(0, 25))] for _ in range(2))
        found = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]


ITEMS = [
    (1, "A train leaves Paris at 9 and travels 120 km in 2 hours while Maria waits, how fast does it go"),
    (2, "what is the name of the river that flows through the old town and under the stone bridge"),
    (3, "two plus two"),
    (4, None),
    (5, ""),
]


def test_decontamination_finds_items_and_other_values(spark):
    noise = " ".join(f"noise{i % 7} filler" for i in range(40))
    other = "A train leaves Rome at 7 and travels 300 km in 5 hours while Anna waits, how fast does it go"
    mixed = "A train leaves Rome at 7 and travels 300 km in 300 hours while Rome waits, how fast does it go"
    texts = {1: f"{noise} {ITEMS[1][1]} {noise}", 2: f"{noise}. {other}. {noise}", 3: noise, 4: "we know that two plus two is four", 5: None, 6: "", 7: f"{noise} the name of the river and under the bridge", 8: f"{noise}. {mixed}. {noise}", 9: ITEMS[1][1].upper() + "\n" + noise}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()] + [(1, texts[1], 0), (None, texts[1], 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(1, 2), (2, 1), (4, 3), (8, 1), (9, 2)}
    left = sorted(r.doc_id for r in decontamination.without_benchmark(docs, bench).filter("doc_id is not null").collect())
    assert left == [3, 5, 6, 7]
    assert decontamination.contaminated(corpus.nothing(spark).drop("rank"), bench).collect() == []
    assert decontamination.contaminated(docs, bench.limit(0)).collect() == []


def test_decontamination_adds_windows_around_inserted_and_deleted_words(spark):
    item = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(37)]
    noise = [f"noise{chr(97 + i % 7)}" for i in range(30)]
    put = [*item[:18], "more", *item[18:]]
    twice = [*item[:12], "more", *item[12:24], "again", *item[24:]]
    out = [*item[:18], *item[19:]]
    texts = [put, out, twice, item[:9], [*item[:18], *noise, *item[18:]]]
    docs = spark.createDataFrame([(i, " ".join([*noise, *t, *noise])) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.matched, r.windows) for r in decontamination.contaminated(docs, bench).collect()}
    # Halves far from each other aren't added: the larger one alone has 12.
    assert found == {0: (23, 30), 1: (22, 30), 2: (16, 30), 4: (12, 30)}


def test_decontamination_discards_windows_that_contradict_the_rest(spark):
    item = "the old ferry carries Maria and then carries Pedro across while we see Maria again with all of her 40 bags near the quay and later Maria goes home by bus"
    same = item.replace("Maria", "Anna").replace("Pedro", "Juan").replace("40", "17")
    once = same.replace("later Anna", "later Clara")
    runs = item.replace("Maria", "Ana Lucia Gomez").replace("40", "1 000")
    never = "the old ferry carries Anna and then carries Juan across while we see Clara again with all of her 40 bags"
    docs = spark.createDataFrame(list(enumerate([item, same, once, runs, never])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: (r.matched, r.windows) for r in decontamination.contaminated(docs, bench, covered=0.1).collect()}
    n = len(item.split()) - 7
    assert found[0] == found[1] == found[3] == (n, n)
    assert 0 < found[2][0] < n and 0 < found[4][0] < n / 2
    assert found[2][0] == sum("Maria" not in " ".join(item.split()[i : i + 8]) or item.split()[i : i + 8].index("Maria") + i < 20 for i in range(n))


def test_decontamination_finds_copies_in_another_case(spark):
    noise = " ".join(f"noise{chr(97 + i % 7)} filler" for i in range(40))
    forms, items = (str, str.lower, str.upper, str.title, str.swapcase), [x for x in ITEMS if x[1]]
    docs = spark.createDataFrame([(10 * i + j, f"{noise}. {form(text)}. {noise}") for i, (_, text) in enumerate(items) for j, form in enumerate(forms)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched / r.windows for r in decontamination.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert found == {(10 * i + j, item): 1.0 for i, (item, _) in enumerate(items) for j in range(len(forms))}


def test_decontamination_of_scripts_without_blanks(spark):
    item = "一列火车早上七点离开巴黎开往里昂行驶三百公里"
    docs = spark.createDataFrame([(1, "我们今天看到" + item + "然后就回家了"), (2, "我们今天看到很多别的东西然后就一起回家了")], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]


def test_decontamination_of_templates_that_repeat(spark):
    """All places match all places: the work grows with them, and the copy is found."""
    repeated = lambda n, start=0: " ".join(f"item {start + i}" for i in range(n // 2))
    docs = spark.createDataFrame([(1, repeated(200)), (2, "some words before it " + repeated(60)), (3, repeated(3000, 7)), (4, "item " * 500)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, repeated(60))], "item_id long, text string")
    found = {r.doc_id: (r.matched, r.windows) for r in decontamination.contaminated(docs, bench).collect()}
    assert found[1] == found[2] == found[3] == (53, 53) and 4 not in found


def shaped(text):
    """(words, template) of ASCII texts by plain code, with and without names."""
    raw = re.findall(r"[A-Za-z]+[.!?:]?|[0-9]+(?:[.,][0-9]+)*", text)
    for names in (True, False):
        shape = []
        for i, w in enumerate(raw):
            bare = w.rstrip(".!?:").lower()
            if w[0].isdigit():
                shape.append("#")
            elif names and i and raw[i - 1][-1] not in ".!?:" and w[0].isupper() and len(w) > 1 and w != w.upper():
                shape.append("@")
            else:
                shape.append("%" if i and raw[i - 1][0].isdigit() and bare in decontamination.UNITS else bare)
        keep = [i for i, s in enumerate(shape) if not (i and s in "#@" and shape[i - 1] == s)]
        yield [raw[i].rstrip(".!?:").lower() for i in keep], [shape[i] for i in keep]


def best_alignment(doc, item, drift=8, size=8):
    """The largest share of the item's windows in any alignment, by trying all."""
    best = (0.0, 0, 0)
    for (iraw, ishape), (draw, dshape) in itertools.product(shaped(item), shaped(doc)):
        n = min(size, len(iraw))
        matched = []
        for i, d in itertools.product(range(len(iraw) - n + 1), range(len(draw) - n + 1)):
            if n and ishape[i : i + n] == dshape[d : d + n]:
                pairs = [(iraw[i + k], draw[d + k]) for k in range(n) if ishape[i + k] in "#@%"]
                if n - len(pairs) >= len(pairs) or all(x == y for x, y in pairs):
                    matched.append((i, d, pairs))
        for start, reach in itertools.product({d - i for i, d, _ in matched}, (0, drift)):
            own = [m for m in matched if start <= m[1] - m[0] <= start + reach]
            counts = Counter(p for m in own for p in m[2])
            stands = {}
            for (x, y), c in sorted(counts.items(), key=lambda e: (-e[1], e[0][1])):
                stands.setdefault(x, y)
            held = {i for i, _, pairs in own if all(stands[x] == y for x, y in pairs)}
            windows = len(iraw) - n + 1
            best = max(best, (len(held) / windows, len(held), windows))
    return best


def test_decontamination_equals_trying_all_alignments(spark):
    pick = random.Random(11)
    plain, proper = ["the", "of", "boat", "runs", "five", "km", "with"], ["Anna", "Bo", "Carl"]
    word = lambda: pick.choice([pick.choice(plain), pick.choice(plain), pick.choice(proper), str(pick.randrange(4))])
    items = [(i, " ".join(word() for _ in range(pick.randrange(3, 26)))) for i in range(12)]
    docs = []
    for i in range(60):
        part = pick.choice(items)[1].split()
        for _ in range(pick.randrange(4)):
            at = pick.randrange(len(part))
            part[at : at + pick.randrange(2)] = [word()] if pick.random() < 0.7 else []
            part = part or ["x"]
        swap = dict(zip(proper, pick.sample(proper, 3), strict=True)) | dict(zip("0123", pick.sample("4567", 4), strict=True))
        part = [swap.get(w, w) for w in part] if pick.random() < 0.5 else part
        text = " ".join([word() for _ in range(pick.randrange(9))] + part + [word() for _ in range(pick.randrange(9))])
        docs.append((i, pick.choice([str, str, str.lower, str.upper])(text)))
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.matched / r.windows, r.matched, r.windows) for r in decontamination.contaminated(*given).collect()}
    wanted = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        share, matched, windows = best_alignment(text, item)
        if matched and matched >= math.ceil(windows * decontamination.COVERED):
            wanted[d, i] = (share, matched, windows)
    assert found == wanted and len(wanted) > 30


def test_decontamination_stays_in_sql(spark):
    docs, bench = corpus.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontamination.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_classifier_separates_and_learns_from_no_held_out_row(spark):
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("aeioustrn") for _ in range(pick.randrange(2, 8)))
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        text = " ".join(word() + ("" if good else pick.choice(["!!", "***", "$$$"])) for _ in range(60))
        rows.append((i, text if good else text.upper(), 0.0))
        marks.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, _score double"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r._score for r in quality.scored(docs, labels, sample=60).collect()}
    assert sum((found[i] >= quality.THRESHOLD) == bool(q) for i, q, _ in marks) >= 396
    held = {r.doc_id for r in docs.filter(quality.held_out()).collect()}
    wrong = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if r.doc_id in held else r.quality, 0)).toDF("doc_id long, quality int, toxic int")
    assert found == {r.doc_id: r._score for r in quality.scored(docs, wrong, sample=60).collect()}


def test_classifier_learns_from_words_alone(spark):
    """Texts of one shape whose words differ, some of them."""
    pick = random.Random(16)
    make = lambda: "".join(pick.choice("aeioustrn") for _ in range(6))
    shared, own = [make() for _ in range(200)], [[make() for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(pick.choice(own[i % 2]) if pick.random() < 0.3 else pick.choice(shared) for _ in range(80))) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = quality.scored(docs, labels).withColumn("held", quality.held_out()).filter("held").collect()
    assert len(found) > 50 and sum((r._score >= 0.5) == bool(r.doc_id % 2) for r in found) >= 0.95 * len(found)


def test_classifier_on_held_out_rows_of_the_tables(spark):
    """On sf0.1 825 held-out rows gave accuracy 0.9988 and area under the curve 1.0; 85 % of them are of quality 1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rated = quality.scored(docs.select("doc_id", "text"), labels).withColumn("held", quality.held_out()).filter("held")
    found = rated.join(labels, "doc_id").collect()
    assert len(found) > 50 and sum((r._score >= quality.THRESHOLD) == bool(r.quality) for r in found) >= 0.97 * len(found)


def test_classifier_chooses_among_repeated_ids_alike(spark):
    rows = [(i % 40, f"{'good words here' if i % 3 else 'BAD!! $$$'} {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = lambda parts: {(r.doc_id, r.text): r._score for r in quality.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels).collect()}
    assert scores(1) == pytest.approx(scores(7), abs=1e-5)  # single-precision products


def test_classifier_takes_any_rows(spark):
    labels = spark.createDataFrame([(r[0], i % 3 % 2, None) for i, r in enumerate(corpus.rows())] + [(4, None, 0), (7, 5, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.scored(corpus.documents(spark), labels).collect()
    assert len(found) == len(corpus.rows()) and all(0 <= r._score <= 1 for r in found)
    assert {r._score for r in found if not r.text} == {0.5}
    assert {r._score for r in quality.scored(corpus.documents(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.scored(corpus.nothing(spark), labels).collect() == []


def test_sha_of_the_query_matches_the_operator(spark):
    texts = ["x" * 10, "y" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: hashlib.sha256(bytes(r._kept)).hexdigest() for r in suffixes.without_repeats(docs).collect()}
    assert kept[0] == hashlib.sha256(b"x" * 10).hexdigest() and kept[1] == hashlib.sha256(b"").hexdigest()


def test_classifier_learns_from_the_column_it_scores(spark):
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(corpus.rows()) if r[0]], "doc_id long, quality int, toxic int")
    docs = corpus.documents(spark).select("doc_id", "text")
    wanted = {r.doc_id: r._score for r in quality.scored(docs, labels).collect()}
    other = docs.withColumnsRenamed({"text": "body_of_it", "doc_id": "key"}).withColumn("text", F.lit("something else"))
    assert {r.key: r._score for r in quality.scored(other, labels, text="body_of_it", doc_id="key").collect()} == wanted


def test_the_vote_equals_a_plain_vote():
    rng = np.random.Generator(np.random.PCG64(2))
    counts = rng.poisson(0.05, (60, quality.TERMS)).astype(np.float32)
    labels = (np.arange(60) % 3 == 0).astype(np.int64)
    model = quality.fit_arrays(counts, labels)
    asked = rng.poisson(0.05, (9, quality.TERMS)).astype(np.float32)
    asked[4] = 0
    for got, row in zip(model.scores(asked), asked, strict=True):
        if not row.any():
            assert got == 0.5
            continue
        near = sorted(((float(model.latent(row[None])[0] @ v), int(l)) for v, l in zip(model.vectors, labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(s, 0) ** quality.POWER + 1e-9, l) for s, l in near]
        assert got == pytest.approx(sum(w * l for w, l in votes) / sum(w for w, _ in votes), abs=1e-4)
