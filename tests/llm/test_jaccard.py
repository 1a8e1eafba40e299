"""The n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import corpus
from waxwing.llm import jaccard
from waxwing.operators.components import components
from waxwing.llm.textkit import U, shingle_sets


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset({tuple(words)} if words else ())


def brute(rows: list[tuple]) -> Counter:
    """(doc_id, n, smallest reachable id) of each row, by its text."""
    sets = sorted({shingles(r[1]) for r in rows}, key=repr)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(a)] = find(b)
    least: dict = {}
    for r in rows:
        if r[0] is not None:
            key = find(shingles(r[1]))
            least[key] = min(r[0], least.get(key, r[0]))
    return Counter((r[0], len(shingles(r[1])), least.get(find(shingles(r[1]))) if shingles(r[1]) else r[0]) for r in rows)


@pytest.mark.parametrize("few", [8, 2])
def test_components_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    found = jaccard.jaccard_components(corpus.documents(spark))
    assert Counter(map(tuple, found.collect())) == brute(corpus.rows())


def test_many_near_copies_and_a_common_passage(spark):
    """Groups larger than FEW: families about several texts, links between members but not to every head."""
    pick = random.Random(3)
    words = [f"v{i}" for i in range(900)]
    common = " ".join(pick.choice(words) for _ in range(30))
    rows = []
    for family in range(3):
        base = [pick.choice(words) for _ in range(90)]
        for i in range(40):
            copy = list(base)
            at = pick.randrange(0, 80)
            for j in range(at, at + i % 9):
                copy[j] = pick.choice(words)
            rows.append((family * 100 + i, " ".join(copy) + " " + common, None, None, 0, 0, 0, ""))
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == brute(rows)


def test_a_hot_group_about_the_threshold(spark, monkeypatch):
    """500 copies of one text that link to few of the others: its keys are hot, and most near pairs are no links."""
    monkeypatch.setattr(jaccard, "TILE", 50)
    pick = random.Random(17)
    base = [f"b{pick.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(500):
        copy = list(base)
        at = pick.randrange(0, 65)
        for j in range(at, at + pick.choice((3, 5, 7, 8, 9, 12))):
            copy[j] = f"c{pick.randrange(10**6)}"
        rows.append((i, " ".join(copy), None, None, 0, 0, 0, ""))
    wanted = brute(rows)
    assert 20 < len({c for _, _, c in wanted}) < 480
    assert Counter(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, corpus.SCHEMA).repartition(6)).collect())) == wanted


def test_tiles_give_fewer_pairs_than_rows():
    pick = np.random.default_rng(4)
    base = pick.integers(0, 1 << 63, 200, dtype=U)
    sets = [np.unique(np.concatenate((base[pick.random(200) < 0.97], pick.integers(0, 1 << 63, 3, dtype=U)))) for _ in range(60)]
    rows = pa.table({"key": [1] * 60 + [2] * 60, "cls": [*range(60)] * 2, "root": [*range(60)] * 2, "n": [len(x) for x in sets] * 2, "sketch": pa.array([jaccard.dense_sketch(x) for x in sets] * 2, pa.binary()), "tile": pa.array([0] * 120, pa.int32()), "lo": pa.array([0] * 120, pa.int32()), "hi": pa.array([0] * 120, pa.int32())})
    assert jaccard._doubtful(rows).num_rows == 120 and jaccard._doubtful(rows).column("b").null_count == 120
    for root, pairs in (([0] * 59 + [1], 0), ([0] * 60, 0)):  # one document is near 59 others: crowded; none: nothing
        made = jaccard._doubtful(rows.set_column(2, "root", pa.array(root * 2)))
        assert made.num_rows == 120 * len({*root} - {0}) and made.num_rows - made.column("b").null_count == pairs
    two = rows.slice(0, 4).set_column(2, "root", pa.array([5, 5, 5, 6])).set_column(3, "n", pa.array([1, 1, len(sets[2]), len(sets[3])]))
    assert [(r["cls"], r["b"]) for r in jaccard._doubtful(two).to_pylist()] == [(2, 3)]
    settled = jaccard._settled(rows.append_column("shingles", pa.array([x.tobytes() for x in sets] * 2, pa.binary())))
    assert settled.num_rows == 59


def test_frequent_keys_leave_their_bucket():
    rows = np.zeros(30, jaccard._KEY)
    rows["key"], rows["cls"] = np.repeat([3, 4], [25, 5]), np.arange(30)
    dealt = jaccard._dealt([rows], 2, 7)
    packed = {b: jaccard.unpacked(k) for b, k in zip(dealt.column("bucket").to_pylist(), dealt.column("keys").to_pylist(), strict=True)}
    assert len(packed[1]) == jaccard.FEW + 1 and len(packed[0]) == 5 and len(packed[7]) == 25 - jaccard.FEW - 1


def test_empty_table(spark):
    assert jaccard.jaccard_components(corpus.nothing(spark)).collect() == []


def test_keep_first_keeps_one_of_each_group(spark):
    kept = jaccard.keep_first(corpus.documents(spark)).collect()
    expected = {(i, c) for i, n, c in brute(corpus.rows()) if n == 0 or i == c}
    assert {r.doc_id for r in kept if r.doc_id is not None} == {i for i, _ in expected if i is not None}
    assert len([r for r in kept if r.doc_id == corpus.rows()[20][0]]) <= 1


def test_hamming_never_exceeds_the_difference():
    pick = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(pick.integers(0, 1 << 63, pick.integers(1, 300), dtype=U))
        b = np.unique(np.concatenate((a[pick.random(len(a)) < 0.9], pick.integers(0, 1 << 63, pick.integers(1, 40), dtype=U))))
        assert jaccard.hamming(jaccard.dense_sketch(a), jaccard.dense_sketch(b)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_keys_by_the_pigeonhole():
    """For linked sets of any sizes, more keys are shared than either may drop."""
    pick = np.random.default_rng(2)
    for n in [*range(1, 40), 64, 100, 200, 500]:
        for _ in range(20):
            a = np.unique(pick.integers(0, 1 << 63, n, dtype=U))
            out, into = pick.integers(0, len(a) // 4 + 1), pick.integers(0, len(a) // 3 + 1)
            b = np.unique(np.concatenate((pick.permutation(a)[out:], pick.integers(0, 1 << 63, into, dtype=U))))
            both = len(np.intersect1d(a, b))
            if 4 * both < 3 * (len(a) + len(b) - both):
                continue
            keys = [{c: (set(k.tolist()), s) for k, c, s in jaccard.pigeonhole_keys(x)} for x in (a, b)]
            assert any(len(keys[0][c][0] & keys[1][c][0]) > max(keys[0][c][1], keys[1][c][1]) for c in keys[0].keys() & keys[1].keys())


def test_words_are_cut_like_the_pattern():
    import pyarrow as pa

    texts = ["a\x0bb\x0cc d\re", "A É ß", " x y", "a" * 70000 + " b"]
    for i, s in shingle_sets(pa.array([t.encode() for t in texts])):
        assert len(s) == len(shingles(texts[i]))


def test_components_of_a_chain_a_star_and_loops(spark, tmp_path):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(edges, "u long, v long").repartition(5), f"file://{tmp_path}/c").collect()
    roots = {r.node: r.root for r in found}
    assert all(roots[i] == 0 for i in range(1, 61)) and all(roots[i] == 100 for i in range(101, 140)) and roots[201] == 200
    assert len(found) == len(roots)


def test_keep_first_tells_rows_of_one_id_apart(spark):
    """Each component with an id keeps one row that has one: none is lost with another row of its id, none stays twice."""
    text = lambda seed: " ".join(f"{seed}w{i}" for i in range(60))
    near = lambda seed, n: " ".join([*text(seed).split(), *(f"more{n}x{i}" for i in range(3))])
    kept = lambda rows: sorted((r.doc_id, r.text) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)).collect())
    a, b = text("a"), text("b")
    assert kept([(1, a, 0), (5, a, 0), (5, b, 0)]) == [(1, a), (5, b)]
    assert len(kept([(5, a, 0), (5, near("a", 1), 0)])) == 1
    assert kept([(5, a, 0), (5, b, 0), (7, near("a", 1), 0), (8, near("b", 2), 0)]) == [(5, a), (5, b)]
    assert kept([(5, a, 0), (5, a, 1), (5, "", 0), (5, "", 0), (6, "", 0)]) == [(5, ""), (5, ""), (5, a), (6, "")]
    # Over any table: the rows kept are one of each component with an id, by brute force over the components.
    docs = corpus.documents(spark)
    whole = jaccard._members(docs, "text", "doc_id").filter("doc_id is not null and n_shingles > 0").collect()
    after = jaccard._members(jaccard.keep_first(docs), "text", "doc_id").filter("doc_id is not null and n_shingles > 0").collect()
    assert {r.root for r in after} <= {r.cls for r in whole} and len(after) == len({r.root for r in whole})


def test_packed_keys_come_back():
    pick = np.random.default_rng(4)
    rows = np.empty(70000, jaccard._KEY)
    rows["key"], rows["cls"] = pick.integers(0, 1 << 48, len(rows), dtype=U), pick.integers(-(1 << 62), 1 << 62, len(rows))
    rows["cfg"], rows["spare"] = pick.integers(0, 128, len(rows)), np.arange(len(rows)) % 65536
    again = jaccard.unpacked(jaccard.packed(rows))
    assert all((again[c] == rows[c]).all() for c in ("key", "cls", "cfg"))
    assert (again["spare"] <= rows["spare"]).all() and (16 * again["spare"].astype(int) >= 15 * rows["spare"].astype(int)).all()
    assert len(jaccard.unpacked(jaccard.packed(rows[:0]))) == 0
