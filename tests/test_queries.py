"""Every registered query against its DuckDB statement, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        tuple(f"{v[i]:.6f}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values
    )


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "events", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    found = got.collect()
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert found
        return
    wanted = duck.sql(statement)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.columns, found) == rows(wanted.columns, wanted.fetchall())


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
