import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.functions.labels import canonical_system, with_canonical_contact
from tessellar.operators.wide import Attribute, attribute_grid, filled_cells, project_panel, supplied_cells

PANEL = [Attribute(2, "B_R1", "b"), Attribute(1, "A_R1", "a"), Attribute(3, "C_R1", "n", "int")]
SCHEMA = "contact string, system string, frequency double, loaded_at timestamp, row_id long, value string"
T = [dt.datetime(2025, 1, d) for d in range(1, 5)]


def grid(spark, rows):
    return attribute_grid(spark.createDataFrame(rows, SCHEMA), "contact", "system", "frequency", "loaded_at", "row_id", PANEL)


def test_latest_wins_then_smallest_row(spark):
    rows = [("x", "A_R1", 0.1, T[0], 1, "e"), ("x", "A_R1", 0.2, T[1], 3, "e"), ("x", "A_R1", 0.3, T[1], 2, "e"), ("x", "A_R1", 0.9, None, 9, "e"), ("x", "A_R1", None, T[3], 8, "e")]
    g = grid(spark, rows + rows)
    assert [tuple(r) for r in project_panel(g, "contact", PANEL).collect()] == [("x", 0.3, None, None)]
    assert [tuple(r) for r in filled_cells(g, "contact", "system", "row_id", PANEL).collect()] == [("x", "A_R1", 2)]


def test_grid_is_complete(spark):
    rows = [("only other", "Z_R9", 0.1, T[0], 1, None), ("unusable", "A_R1", None, T[0], 2, None), (None, "A_R1", 0.5, T[0], 3, None), ("no system", None, 0.5, T[0], 4, None), ("whole", "C_R1", 1.0, T[0], 5, None), ("broken", "C_R1", math.inf, T[0], 6, None)]
    out = {r[0]: tuple(r)[1:] for r in project_panel(grid(spark, rows), "contact", PANEL).collect()}
    assert out == {"only other": (None,) * 3, "unusable": (None,) * 3, "no system": (None,) * 3, "whole": (None, None, 1), "broken": (None,) * 3}


def test_empty_table_and_empty_panel(spark):
    assert project_panel(grid(spark, []), "contact", PANEL).collect() == []
    some = spark.createDataFrame([("x", "A_R1", 0.1, T[0], 1, "e")], SCHEMA)
    g = attribute_grid(some, "contact", "system", "frequency", "loaded_at", "row_id", [])
    assert [tuple(r) for r in project_panel(g, "contact", []).collect()] == [("x",)]


def test_too_many_attributes(spark):
    with pytest.raises(ValueError):
        attribute_grid(spark.createDataFrame([], SCHEMA), "contact", "system", "frequency", "loaded_at", "row_id", PANEL * 2000)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["A_R1", "B_R1", "Q_R1"]), st.one_of(st.none(), st.sampled_from([0.0, 0.25, 1.0])), st.sampled_from(T)), max_size=30))
def test_cells_equal_brute_force(spark, drawn):
    rows = [(*r, i, None) for i, r in enumerate(drawn)]
    want = {}
    for c, s, f, t, i, _ in rows:
        if f is not None and ((c, s) not in want or (t, -i) > want[c, s][0]):
            want[c, s] = ((t, -i), f, i)
    out = supplied_cells(spark.createDataFrame(rows, SCHEMA), ["contact", "system"], "frequency", "loaded_at", "row_id").collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in out} == {k: v[1:] for k, v in want.items()}


def test_canonical_contacts(spark):
    rows = [
        ("R:VAL:99-A:ALA:-3", None, None), ("a:ala:-3 - R:Val:99\t", "Z:Z:1", None), (None, "r:val:99", "A:ALA: -3"), ("A:ALA:-3-B:TRP:-4", None, None), (None, "A:ALA:1", None), ("junk", "A:ALA:1", "A:ALA:2"), ("  ", "A:A:2", "A:A:10"), (None, None, None),
    ]
    df = with_canonical_contact(spark.createDataFrame(rows, "contact string, res1 string, res2 string"), "c", "contact", "res1", "res2")
    one = "A:ALA:-3-R:VAL:99"
    assert [r["c"] for r in df.collect()] == [one, one, one, "A:ALA:-3-B:TRP:-4", None, None, "A:A:10-A:A:2", None]


def test_canonical_systems(spark):
    names = ["AK12_R7", "ak12_r7_frequencies.tsv", "frequencies/AK12_R7.tsv", " AK12_R7_Frequencies.TSV ", "AK12_R7\t", "", None, "R7", "AK12 _R7"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(canonical_system(F.col("s")))
    assert [r[0] for r in df.collect()] == ["AK12_R7"] * 5 + [None] * 3 + ["AK12_R7"]
