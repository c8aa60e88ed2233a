"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from carelake import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    text, _, good = check.compare(spark, con, SF_DIR, name)
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
