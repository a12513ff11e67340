"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as entry
from uttermill.plans import registry

OWN = set(registry.QUERIES)  # the optional operators have their own tests
SQL = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert OWN == set(SQL) and OWN <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    r = entry.entry(spark).collect()
    assert len(r) == 1 and r[0].accuracy > 0.9
