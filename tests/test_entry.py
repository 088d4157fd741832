"""Every registered query against its SQL counterpart on the smallest test data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from shelfwise.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_is_registered_and_has_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
