"""Every registered query with a DuckDB statement returns the same rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from plenum.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v.isoformat() if isinstance(v, datetime.datetime) else v)


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(v) for v in r] for r in df.select(*[f"`{n}`" for n in names]).collect())
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    assert got == sorted([plain(r[i]) for i in at] for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    compare(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_statement_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert rows and not any(all(v is None for v in r) for r in rows)
