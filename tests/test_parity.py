"""Every registered query against its SQL restatement, on the smallest data."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from palaver.plans.catalogue import QUERIES  # noqa: E402
from palaver.plans.oracle import ORACLE  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"tfidf_logreg"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{name}'")
    return connection


def test_all_queries_have_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    relation = sql.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    expected = sorted((tuple(row[i] for i in places) for row in relation.fetchall()), key=repr)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
