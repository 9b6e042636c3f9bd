"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as driver
from check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck.sql(STATEMENTS[name])) is None


def test_entry_runs(spark):
    assert driver.entry(spark).limit(1).count() == 1
