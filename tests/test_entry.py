"""Every query with SQL gives what the SQL gives."""

import glob
import os
from numbers import Real

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def canon(df):
    def one(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(float(x)) if isinstance(x, Real) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_oracle(spark, con, name):
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and canon(a) == canon(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
