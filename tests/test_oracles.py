"""Every query against its SQL in DuckDB on the smallest tables, values and column names."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from listingmill.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return (int(v) if v == int(v) else round(v, 6)) if isinstance(v, float) else v


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
