"""Trees by doubled pointers against walking them."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import ROOT
from waxwing.operators import hierarchy


def walked(nodes):
    """(ancestors with levels, paths) by following parents."""
    parent, name = {i: p for i, _, p in nodes}, {i: n for i, n, _ in nodes}
    above, paths = {}, {}
    for i in parent:
        chain, at = {}, i
        while at in parent and at not in chain:
            chain[at] = len(chain)
            at = parent[at]
        above[i] = dict(chain)
        if at in parent:
            continue  # a ring
        if at not in (None, "ROOT"):
            above[i][at] = len(chain)
        if at == "ROOT":
            paths[i] = (len(chain) - 1, "/".join(name[x] for x in reversed(chain)))
    return above, paths


def some_nodes(kind):
    pick = random.Random(kind)
    if kind == 1:  # a deep chain
        return [(f"n{i}", f"k{i % 7}", "ROOT" if not i else f"n{i - 1}") for i in range(300)]
    nodes = [(f"n{i}", pick.choice("abc"), "ROOT" if i < 3 else f"n{pick.randrange(i)}") for i in range(150)]
    nodes += [("o1", "a", "gone"), ("o2", "b", "o1"), ("x", "a", None)]
    nodes += [(f"r{i}", "a", f"r{(i + 1) % 5}") for i in range(5)] + [("q", "b", "r2"), ("self", "c", "self")]
    return nodes


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_trees_equal_walking(spark, kind):
    nodes = some_nodes(kind)
    above, paths = walked(nodes)
    table = spark.createDataFrame(nodes, "id string, name string, parent_id string")
    start = [n[0] for n in nodes][:: 7 if kind == 1 else 1] + ["unknown"]
    asked = spark.createDataFrame([(i,) for i in start], "id string")
    found = {(r.of, r.id): r.level for r in hierarchy.ancestors(table, asked).collect()}
    wanted = {(i, a): n for i in start for a, n in above.get(i, {i: 0}).items()}
    assert found == wanted
    below = {(r.top, r.id): r.level for r in hierarchy.descendants(table, asked).collect()}
    wanted = {(a, i): n for i, own in above.items() for a, n in own.items() if a in start} | {(i, i): 0 for i in start}
    assert below == wanted
    assert {r.id: (r.depth, r.path) for r in hierarchy.paths(table).collect()} == paths


def test_empty_trees(spark):
    none = spark.createDataFrame([], "id string, name string, parent_id string")
    assert hierarchy.paths(none).collect() == hierarchy.ancestors(none, none).collect() == []


def test_the_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("left", [True, False])
def test_the_rest_works_without_the_llm_folders(tmp_path, left):
    """In a copy without them, whether the interpreter's own leftovers stay or not."""
    for name in ("waxwing", "__spark_entry__.py", "corpus_pipeline.py"):
        source = Path(ROOT) / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists() and (left or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    if left:
        (tmp_path / "waxwing/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
