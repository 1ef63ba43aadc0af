"""Every query of the catalog: against its SQL, or at least rows with a stable schema."""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver
from railtempo.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert QUERIES.items() <= driver.queries().items() and SQL.items() <= driver.oracle_sql().items()
    assert driver.entry(spark).columns == ["station_id", "n", "max_severity", "band"]
