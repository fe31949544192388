"""Registered queries: flagship smoke run and SQL comparison on the smallest data."""

import pytest

import __spark_entry__ as entry
from catalog.oracles import all_oracles
from catalog.queries import all_queries
from tests.oracle_compare import connect, difference, oracle_result, spark_result

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["phase"] for r in rows} == {"Phase I", "Phase II", "Phase III"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # Every query of this package's own catalog has its SQL.
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, sf_dir, connection, name):
    ours = spark_result(QUERIES[name](spark, sf_dir))
    assert difference(ours, oracle_result(connection, ORACLES[name])) is None
