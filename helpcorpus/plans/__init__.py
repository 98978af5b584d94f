"""The operators bound to tables: queries by key, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, graph, indexing  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL, Tables, full_sql


def _bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bound(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: full_sql(k) for k in SQL}
