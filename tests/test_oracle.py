"""Every registered query with an oracle equals DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())
