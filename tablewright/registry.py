"""Query registry feeding ``__spark_entry__``.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` over the given
tables; ``sql`` is the independent DuckDB statement computing the same
result (omitted only for operators SQL cannot express).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}

_MODULES = (
    "tablewright.queries.relational",
    "tablewright.queries.aggregates",
    "tablewright.queries.dml",
    "tablewright.queries.products",
    "tablewright.queries.text",
    "tablewright.queries.graphs",
    "tablewright.queries.reports",
)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
