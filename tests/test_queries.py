"""Every registered query runs and gives the rows of its SQL."""

import pytest

import __spark_entry__ as driver
from compare import connect, differences

QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_rows_equal_sql(spark, sf_dir, connection, key):
    assert differences(QUERIES[key](spark, sf_dir), connection, ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["combo_id", "d", "q", "n", "revenue"]
    assert result.count() == 16
