"""Every query with SQL gives the rows that DuckDB gives on the smallest tables; the others run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
OWN = [n for m in entry.MODULES for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(rows(got), rows(want), check_dtype=False)


@pytest.mark.parametrize("name", ["ml7_isolation_forest", "st6_sessions", "m16_fragment_sessions", "g9_stages"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
