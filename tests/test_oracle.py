"""Every core query with SQL gives the rows of the SQL, on the smallest data directory."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from litmill.plans.catalogue import core_queries, core_sql

NAMES = sorted(core_sql())


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{small_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    out = []
    for r in df.itertuples(index=False, name=None):
        out.append(tuple("" if pd.isna(x) else repr(round(float(x), 6)) if isinstance(x, float) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, small_dir, name):
    got = core_queries()[name](spark, small_dir).toPandas()
    want = duck.execute(core_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_sql())))
def test_runs(spark, small_dir, name):
    assert core_queries()[name](spark, small_dir).count() >= 0
