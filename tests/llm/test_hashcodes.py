"""Near duplicates of vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waxwing.llm import hashcodes

SCHEMA = "vec_id long, embedding array<float>, label int, _n_links string, x string"


def vectors(dims: int = 24, seed: int = 3) -> list[tuple]:
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.standard_normal((60, dims))
    rows, i = [], 0
    for b in base:
        for spread in (0, 0, 0.05, 0.15, 0.19, 0.2, 0.22):  # about the cosine and on both sides of it
            x = b / np.linalg.norm(b)
            step = rng.standard_normal(dims)
            rows.append((i * 7 % 1009, [float(v) for v in (x + spread * step / np.linalg.norm(step)) * rng.choice([0.1, 1, 30])], int(i % 3), "a", "b"))
            i += 1
    hot = base[0] / np.linalg.norm(base[0])
    rows += [(2000 + j, [float(v) for v in hot + 0.08 * rng.standard_normal(dims) / dims**0.5], 1, "a", "b") for j in range(150)]
    rows += [(3000 + j, rows[0][1], 1, "a", "b") for j in range(40)]
    one = [1.0] + [0.0] * (dims - 1)
    rows += [(4000, None, 1, "a", "b"), (4001, [0.0] * dims, 1, "a", "b"), (4002, [float("nan")] * dims, 1, "a", "b"), (4003, [None, *one[1:]], 1, "a", "b"), (4004, one, None, "a", "b"), (4005, one, None, "a", "b")]
    rows += [(4006, [float("inf"), *one[1:]], 1, "a", "b"), (4007, [], 1, "a", "b"), (4008, [3.0, 4.0], 1, "a", "b"), (4009, [30.0, 40.0], 1, "a", "b"), (None, rows[0][1], 1, "a", "b"), (None, None, None, None, None)]
    rows += [(5000, one, 1, "a", "b"), (5000, one, 1, "a", "b"), (5000, [-v for v in one], 1, "a", "b"), (5001, [1e-30 * v for v in one], 1, "a", "b")]
    return rows


def all_pairs(rows: list[tuple], least: float) -> list[tuple]:
    links: dict[int, set[int]] = {i: set() for i in range(len(rows))}
    fine = {}
    for i, (_, x, label, *_rest) in enumerate(rows):
        if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            fine[i] = (v, np.linalg.norm(v))
    for i, (v, n) in fine.items():
        for j, (w, m) in fine.items():
            if i < j and rows[i][2] == rows[j][2] and len(v) == len(w) and v @ w / (n * m) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        head = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), head, r[0] == head))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(2048, 8192, 32768), (20, 30, 40), (5, 64, 16)])
def test_equal_to_all_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("WHOLE", "OWNERS", "VISITORS"), sizes, strict=True):
        monkeypatch.setattr(hashcodes, name, size)
    rows = vectors()
    out = hashcodes.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 0.98)
    assert "_n_links_" in out.columns and {"x", "_n_links"} <= set(out.columns)
    found = sorted(((r.vec_id, r._n_links_, r._component, r._kept) for r in out.collect()), key=repr)
    assert found == all_pairs(rows, 0.98)
    assert sum(r[1] for r in found) > 30_000


def test_no_vectors(spark):
    assert hashcodes.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = hashcodes.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 1, "a", "b")], SCHEMA)).collect()
    assert (row._n_links_, row._component, row._kept) == (0, 3, True)


def test_small_steps_find_the_same(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.standard_normal(16) + 0.1 * rng.standard_normal((90, 16))
    norms, ids, both, turn = np.linalg.norm(x, axis=1), np.arange(90), np.ones(90, bool), hashcodes.fitted(x, 16)
    cosines = (x @ x.T) / np.outer(norms, norms)
    wanted = {(i, j) for i in range(90) for j in range(i) if cosines[i, j] >= 0.99}
    assert wanted
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(hashcodes, "PAIRS", pairs)
        found = [(max(a, b), min(a, b)) for s, t in hashcodes.linked(x, norms, ids, both, both, turn, [0, 1, 2, 3], 0.99) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == wanted


def test_rotation_balances_bits(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rotation = hashcodes.fitted(unit)
    axes = rotation.axes / hashcodes.GRID
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-2
    turned = rotation.turned(x, np.linalg.norm(x, axis=1))
    share = (turned >= 0).mean(axis=0)
    assert 0.3 < share.min() and share.max() < 0.7
    # Nearer to the signs than the principal directions are.
    gap = lambda y: ((y - np.sign(y) * np.abs(y).mean()) ** 2).sum()
    centred = unit - unit.mean(axis=0)
    assert gap(turned) < gap(centred @ np.linalg.eigh(centred.T @ centred)[1])


def test_no_pair_leaves_a_task(spark):
    """A thousand near copies give rows by the thousand, not by the million."""
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, [float(v) for v in 1 + 0.01 * rng.standard_normal(8)], 1, "a", "b") for i in range(1000)]
    out = hashcodes.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.filter(F.col("_n_links_") == 999).count() == 1000 and out.filter("_kept").count() == 1
