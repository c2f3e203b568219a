"""Every registered query against its SQL on the smallest tables; the rest must return rows."""

import os

import pytest

from panelweave.plans import registry
from tests.compare import check_engine, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = registry.load()
TOO_SMALL: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return check_engine(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_agrees_with_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, QUERIES[name], CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - TOO_SMALL))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
