"""The registered queries: a name, a function of (spark, directory), and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "smart_any"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under ``name``, with its SQL where there is one."""

    def add(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: The modules that register queries.
MODULES = ("predicates", "joins", "text", "music", "sequences", "similarity", "catalogue", "streams", "sources")


def _load() -> None:
    for name in MODULES:
        import_module(f"waxwing.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
