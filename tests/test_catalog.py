"""Every query of the catalogue gives the rows of its SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from marlstone.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{name}')")
    return con


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(list(value)) if hasattr(value, "__len__") and not isinstance(value, str) else str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_as_sql(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), sql.execute(catalog.SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "c_name", "n_name", "r_name", "o_totalprice", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
