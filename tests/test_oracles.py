"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["orders", "documents", "pages", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    expected = sorted(map(repr, cursor.fetchall()))
    actual = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert len(expected) > 0
    assert len(actual) == len(expected)
    assert actual == expected


def test_all_but_the_scan_have_an_oracle():
    assert set(entry._reference_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
