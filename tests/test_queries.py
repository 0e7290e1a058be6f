"""Each registered query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    out = []
    for r in df[columns].itertuples(index=False):
        out.append("|".join("~" if x is None or x is pd.NaT or x is pd.NA or x != x else str(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(want), "an empty result compares nothing"


@pytest.mark.parametrize("name", sorted(set(entry._own.QUERIES) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0
