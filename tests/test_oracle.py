"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from helpcorpus import plans
from helpcorpus.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("key", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, key):
    df = plans.queries()[key](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(plans.oracle_sql()[key])
    assert sorted(want.columns) == names
    mine = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    at = [want.columns.index(n) for n in names]
    assert mine == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("key", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, key):
    assert plans.queries()[key](spark, SF).count() > 0
