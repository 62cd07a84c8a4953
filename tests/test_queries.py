"""Every query with SQL gives DuckDB's rows; the others run."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vigilmill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else str(x)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(str([_plain(v) for v in r]) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", plans.ORACLE_SQL)
def test_same_as_duckdb(spark, duck, name):
    assert _rows(plans.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(plans.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "documents", "prints", "hostile"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
