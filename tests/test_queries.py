"""Every registered query against its SQL on the smallest test tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import Q
from checks.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(Q)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF_DIR, name) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(Q) <= set(entry.oracle_sql()) <= set(entry.queries())
