"""Registry of named queries: Spark builder + (optional) DuckDB oracle SQL.

Each entry is ``name → (fn(spark, sf_dir) → DataFrame, sql | None)``.
Modules register their queries with :func:`query`; ``__spark_entry__``
exposes the registry to the driver.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    from . import queries  # noqa: F401  (registers everything)
    return REGISTRY


def oracle(name: str) -> str | None:
    sql = load_all()[name][1]
    return sql() if callable(sql) else sql
