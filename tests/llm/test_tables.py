"""Mixing, sharding, neighbours, token counts, training order, the pipeline and the registered SQL."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, TABLES
from tests.llm import corpus
from waxwing.llm import mixing, neighbours, queries, sharding, tokencount, tokenorder, tokens


def filled(sizes: dict, share=1.5, most=2.0) -> dict:
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing_meets_targets(spark):
    sized = corpus.documents(spark).withColumn("size", mixing.word_count())
    found = mixing.mixture(sized, "size").collect()
    assert len(found) == len(corpus.rows())
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r._copies
        target[r.source] = r._target
        assert 0 <= r._copies <= 2 and (r._source_size is not None)
    for s, t in filled(sizes).items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= max(r.size for r in found if r.source == s) * 2 + 1
    again = mixing.mixture(sized.repartition(5), "size").collect()
    key = lambda rows: Counter((r.doc_id, r.text, r.source, r._copies) for r in rows)
    assert key(found) == key(again)
    assert mixing.emitted(mixing.mixture(sized, "size")).count() == sum(r._copies for r in found)
    assert mixing.mixture(corpus.nothing(spark).withColumn("size", mixing.word_count()), "size").collect() == []


def test_sharding_by_key(spark):
    found = sharding.sharded(corpus.documents(spark)).collect()
    assert len(found) == len(corpus.rows())
    for r in found:
        data = (r.text or "").encode()
        assert r._size == len(data) + 16 and r._crc32 == zlib.crc32(data)
        assert r._grown_shard in (r._shard, 40) and 0 <= r._shard < 40
    slots = defaultdict(list)
    for r in found:
        slots[r._shard].append(r._slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = {(r.doc_id, r._shard) for r in found}
    assert len(by_id) == len({r.doc_id for r in found})
    assert sharding.sharded(corpus.nothing(spark)).collect() == []


def test_sharding_shares_and_movement(spark):
    ids = spark.range(20000).selectExpr("cast(id as string) AS id")
    weights = {3: 2.0, 7: 0.5}

    rows = ids.select(sharding.placed(F.col("id"), sharding.tree(40)).alias("a"), sharding.placed(F.col("id"), sharding.tree(41)).alias("b"), sharding.placed(F.col("id"), sharding.tree(40, weights=weights)).alias("w")).collect()
    count, weighed = Counter(r.a for r in rows), Counter(r.w for r in rows)
    assert set(count) == set(range(40)) and max(count.values()) < 2 * min(count.values())
    assert weighed[3] > 1.6 * count[3] * 0.85 and weighed[7] < 0.75 * count[7]
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {40} and 300 < len(moved) < 700
    assert all(r.w // 10 == 0 for r in rows if r.a != r.w and r.a // 10 > 0)  # only into the region that grew


def test_neighbours_reach_the_recall(spark):
    pick = np.random.default_rng(3)
    centres = pick.standard_normal((20, 16))
    x = centres[pick.integers(0, 20, 1500)] + 0.3 * pick.standard_normal((1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (3400, []), (None, x[0].tolist()), (100, x[100].tolist()), (7, x[200].tolist())]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
        assert r.vec_id != r.query_id
    assert set(by) == set(range(0, 1500, 100))
    hit = 0
    for q, got in by.items():
        gap = {i: float(np.sqrt(((x[i] - x[q]) ** 2).sum())) for i in range(1500) if i != q}
        other = float(np.sqrt(((x[200] - x[q]) ** 2).sum()))  # of the other row of id 7
        best = sorted([*((g, i) for i, g in gap.items()), (other, 7)])[:10]
        hit += len({i for _, i in best} & {i for i, _ in got})
        assert len(got) == 10 and all(s == pytest.approx(gap[i], abs=1e-12) or i == 7 and s == pytest.approx(other, abs=1e-12) for i, s in got)
        assert [s for _, s in got] == sorted(s for _, s in got)
    assert hit / (10 * len(by)) >= 0.9
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_neighbours_of_repeated_ids_are_rows(spark):
    """Rows that repeat an id are candidates each, equal ones too; a query's id asks once and is no candidate of its own."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 1.0])] + [(1, [1.0 + 0.001 * i, 1.0]) for i in range(1, 60)] + [(i, (5 + rng.random(2)).tolist()) for i in range(2, 30)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in found)
    assert got == [(i, 1, round(0.001 * i, 9)) for i in range(1, 11)]
    again = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [1.0, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in again) == [(1, 5, 0.0), (2, 5, 0.0), (3, 4, 0.5)]


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    x = np.random.default_rng(5).standard_normal((900, 8))
    found = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    best = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) for q in range(0, 900, 100)}
    assert sum(r.vec_id in best[r.query_id] for r in found) >= 0.9 * 90


def test_token_counts_equal_the_encoding(spark):
    for block in (64, 1 << 20):
        found = Counter(map(tuple, tokencount.document_counts(corpus.documents(spark), block=block).collect()))
        assert found == Counter((r[0], len(tokens.encoded(r[1], tokens.VOCABULARY))) for r in corpus.rows())
    assert tokencount.document_counts(corpus.nothing(spark)).collect() == []


def test_raw_flat_files(spark, tmp_path):
    lengths = {"a.bin": [3, 0, 700, 5], "b.bin": [0], "c.bin": [2000, 1]}
    for name, each in lengths.items():
        ids = [x for n in each for x in [*([7] * n), tokens.END]]
        np.array(ids + ([9, 9] if name == "a.bin" else []), "<u2").tofile(tmp_path / name)
    found = defaultdict(list)
    for r in sorted(tokencount.counts(tokencount.read_flat(spark, f"file://{tmp_path}", block=100)).collect()):
        found[r.file.rsplit("/", 1)[1]].append(r.n_tokens)
    assert found == {"a.bin": [3, 0, 700, 5, 2], "b.bin": [0], "c.bin": [2000, 1]}


@pytest.mark.parametrize("total", [1, 2, 5, 64, 1000, 4097])
def test_the_permutation_is_one(total):
    slots = tokenorder.permuted(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    assert total < 64 or (slots != tokenorder.permuted(np.arange(total), total, key=1)).any()


def test_training_order_round_trip(spark, tmp_path):
    ordered = tokenorder.in_training_order(corpus.documents(spark), length=128, per_shard=16).cache()
    rows = ordered.collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 256 and zlib.crc32(r.tokens) == r.crc32 for r in rows)
    ids = lambda r: np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()
    wanted = Counter(x for r in corpus.rows() for x in [*tokens.encoded(r[1], tokens.VOCABULARY), tokens.END])
    assert Counter(x for r in rows for x in ids(r)) == wanted
    assert {d for r in rows for d in r.doc_ids} == {r[0] for r in corpus.rows()}
    uri = f"file://{tmp_path}/shards"
    written = tokenorder.write_shards(ordered, uri).collect()
    assert sum(r.sequences for r in written) == len(rows) and all(r.bytes == r.sequences * 256 for r in written)
    back = tokenorder.read_from(uri, 13, 30, length=128, per_shard=16)
    assert back.tolist() == [np.frombuffer(r.tokens, "<u2").tolist() for r in rows[13:43]]
    assert tokenorder.in_training_order(corpus.nothing(spark)).collect() == []


def test_training_order_is_that_of_the_documents(spark):
    docs = corpus.documents(spark)
    hashed = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    stream = [(x, i) for i, _, t in sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for x in [*tokens.encoded(t, tokens.VOCABULARY), tokens.END]]
    cut = [stream[at : at + 128] for at in range(0, len(stream), 128)]
    slots = tokenorder.permuted(np.arange(len(cut)), len(cut))
    wanted = {int(s): ([x for x, _ in c], [i for n, (_, i) in enumerate(c) if n == 0 or c[n - 1][0] == tokens.END]) for s, c in zip(slots, cut, strict=True)}
    for parts in (1, 7):
        rows = tokenorder.in_training_order(docs.orderBy(F.desc("doc_id")).repartition(parts), length=128, per_shard=16).collect()
        assert {r.slot: (np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist(), r.doc_ids) for r in rows} == wanted


def test_training_order_of_one_repeated_row(spark):
    rows = tokenorder.in_training_order(spark.range(900).selectExpr("1L AS doc_id", "'a b c' AS text"), length=16, per_shard=4).collect()
    assert len(rows) == len({r.slot for r in rows}) and sum(len(set(r.doc_ids)) for r in rows) == len(rows)
    assert sum(r.n_tokens for r in rows) == 900 * (len(tokens.encoded("a b c", tokens.VOCABULARY)) + 1)


def test_registered_sql(spark):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, f"{DATA}/sf0.001")
        order = sorted(found.columns)
        wanted = con.execute(sql)
        names = [c[0] for c in wanted.description]
        assert sorted(names) == order
        assert Counter(tuple(repr(r[c]) for c in order) for r in found.collect()) == Counter(tuple(repr(r[names.index(c)]) for c in order) for r in wanted.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_jaccard import brute

    directory = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{directory}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, directory).cache()
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            groups = brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {i for i, n, c in groups if n == 0 or i == c}
        if name == "benchmark decontamination":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if any(x in r.text for x in items)}
        if name.startswith("mixing"):
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 2
    assert {"shard", "slot"} <= set(docs.columns) and len(after) == len(before)
