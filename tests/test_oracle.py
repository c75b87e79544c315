"""Every registered query against its SQL oracle, on the small tables."""

import pytest

import __spark_entry__ as entry
from layover import registry
from tests.compare import difference, oracle_connection
from tests.conftest import SF_SMALL

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
ROWS_ONLY = {"sample_rows"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF_SMALL), con, ORACLES[name]) is None


def test_only_these_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_has_one_row(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["total_audit_rows"] > 0
