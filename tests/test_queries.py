"""Every named query against its SQL, and the contract around them."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__
import tidemark.workload
import tidemark.workload_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = dict(tidemark.workload.QUERIES), dict(tidemark.workload_sql.SQL)


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    assert difference(QUERIES[name](spark, FOLDER), database.execute(SQL[name])) is None


def test_comparison_notices_differences(spark, database):
    df = spark.range(2).withColumnRenamed("id", "a")
    assert difference(df, database.execute("SELECT range AS a FROM range(2)")) is None
    for sql in ("SELECT range AS b FROM range(2)", "SELECT range AS a FROM range(3)", "SELECT range + 1 AS a FROM range(2)"):
        assert difference(df, database.execute(sql)) is not None


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
