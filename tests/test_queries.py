"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import math
import os

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"


def value(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    sql = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    columns = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    at = [sql.columns.index(c) for c in columns]
    assert mine == sorted(tuple(value(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
