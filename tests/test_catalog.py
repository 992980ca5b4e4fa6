"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from millrace.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got) == ordered(want)


def test_entry(spark):
    assert entry(spark).count() > 0
