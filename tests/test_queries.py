"""Every query with SQL against DuckDB, the others for rows, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    cell = lambda x: None if x is None or x is pd.NA or x != x else x if isinstance(x, (bool, str)) else float(x) if isinstance(x, (int, float)) else str(x)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
