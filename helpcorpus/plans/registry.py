"""Named tables that operators are bound to, in the SQL of both engines, and the register of queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()
#: name -> (Spark SQL with other tables in braces, DuckDB SQL)
VIEWS: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The corpus tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.found = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.found:
            self.found[name] = self.sql(VIEWS[name][0]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.found[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in set(re.findall(r"\{(\w+)\}", text))})


def view(name: str, spark: str, duck: str | None = None) -> None:
    """A table that others and queries may name; without duck, both engines read the same text."""
    VIEWS[name] = (spark, duck or re.sub(r"\{(\w+)\}", r"\1", spark))


def query(key: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return keep


def _needed(sql: str, seen: list[str]) -> None:
    for n in VIEWS:
        if n not in seen and re.search(rf"\b(?:FROM|JOIN|from|join)\s+{n}\b|,\s*{n}\s+\w", sql):
            _needed(VIEWS[n][1], seen)
            seen.append(n)


def full_sql(key: str) -> str:
    """The query's DuckDB SQL, with the tables it names before it."""
    names: list[str] = []
    _needed(SQL[key], names)
    text = SQL[key].strip()
    if not names:
        return text
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[14:]}"
    return f"WITH {ctes},\n{text[4:]}" if text.upper().startswith("WITH") else f"WITH {ctes}\n{text}"
