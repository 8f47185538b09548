"""Every named query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(df: pd.DataFrame):
    ordered = df[sorted(df.columns)].astype(object)
    return sorted(
        (tuple(None if pd.isna(v) else v for v in row) for row in ordered.itertuples(index=False, name=None)), key=repr
    )


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    found = entry_points.queries()[name](spark, SF).toPandas()
    assert len(found) > 0
    sql = entry_points.oracle_sql().get(name)
    if sql is not None:
        expected = duck.execute(sql).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert comparable(found) == comparable(expected)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["ip", "user", "query", "n", "bytes", "bad_bytes"]
    assert df.count() > 0
