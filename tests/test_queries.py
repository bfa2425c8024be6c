"""Every query outside the optional subpackage against its SQL, on the given tables."""

import duckdb
import pytest

import compare
from tessellar.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.views(duckdb.connect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, compare.SF), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, compare.SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_superposition_keeps_the_sign_of_zero(spark, con):
    """0.0 and -0.0 are equal, so test_equals_sql can't tell them apart."""
    want = con.execute(ORACLES["mat18_superposition"]).fetchall()
    got = QUERIES["mat18_superposition"](spark, compare.SF).collect()
    assert {r["vec_id"]: str(r["xyz"]) for r in got} == {k: str(v) for k, v in want}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
