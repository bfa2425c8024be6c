"""The subpackage's queries against their SQL, on the given tables."""

import duckdb
import pytest

import compare
from tessellar.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.views(duckdb.connect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, compare.SF), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, compare.SF).count() > 0
