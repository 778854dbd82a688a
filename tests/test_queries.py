"""Every registered query against its SQL on the supplied tables."""

import pytest
from compare import compare, connection

import __spark_entry__ as entry
from workload.oracle import ORACLE
from workload.queries import QUERIES

@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and not set(entry.oracle_sql()) - set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns[:3] == ["id_order", "id_client", "status_order"]
