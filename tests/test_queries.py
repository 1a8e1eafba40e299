"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from tests.conftest import DATA, TABLES
from waxwing.plans import registry

QUERIES = sorted(registry.queries())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, oracle, name):
    found = registry.queries()[name](spark, f"{DATA}/sf0.001")
    order = sorted(found.columns)
    rows = [tuple(repr(r[c]) for c in order) for r in found.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(set(order)) == len(order)
        return
    wanted = oracle.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(names) == order
    assert Counter(rows) == Counter(tuple(repr(r[names.index(c)]) for c in order) for r in wanted.fetchall())


def test_resample_nearest_of_products_that_a_float_rounds_to_whole_numbers(spark, tmp_path):
    rows = [(i, [-0.061000000685453415, None, 0.05299999937415123, -0.14900000393390656]) for i in range(4)] + [(4, []), (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = {r.vec_id: r.samples for r in registry.queries()["resample_nearest"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(registry.oracle_sql()["resample_nearest"]).fetchall()) and "-61" in found[0] and "NULL" in found[0]


def _small(spark, path, lines, orders):
    con = duckdb.connect()
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"), ("orders", orders, "o_orderkey long, o_custkey long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def test_reorder_sorts_once(spark, tmp_path):
    con = _small(spark, tmp_path, [(1, 1, 5, 1), (2, 1, 7, 1), (2, 2, 6, 1), (3, 3, 1, 1), (3, 1, 2, 1), (3, 2, 2, 2), (3, 2, 2, 1), (3, 9, 4, 4)], [])
    found = registry.queries()["reorder"](spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(con.execute(registry.oracle_sql()["reorder"]).fetchall())
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1


def test_entries_without_a_key_are_added_once(spark, tmp_path):
    con = _small(spark, tmp_path, [(1, 1, 5, 1), (1, 2, 5, 1), (1, 3, None, 1), (None, 1, None, 1)], [(1, 5), (1, None), (None, None), (2, 5), (2, 5)])
    found = registry.queries()["add_entry_dedup"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(con.execute(registry.oracle_sql()["add_entry_dedup"]).fetchall()) and len(found) == 4
