"""Every registered query against its oracle, on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF
from scorelake.queries.fixtures import TABLES

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    cols = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(tuple(canon(r[c]) for c in cols) for r in rows) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
