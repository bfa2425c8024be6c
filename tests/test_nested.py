import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellar.operators.nested import as_int, dewey_text, flat_table, label_nodes, parent, schema_table, shred

ALT = "alternative_generic_numbers"


def test_labels_and_links(spark):
    doc = {"data": [{"naming": [{"sequence_number": 5, ALT: [None, {"scheme": "BW", "label": "1.50"}, 7]}, {"sequence_number": "6", ALT: {"scheme": "S", "label": "x"}}, {ALT: [{"scheme": "BW", "label": "2.50"}]}]}]}
    rows = [(1, json.dumps(doc), "e"), (2, json.dumps(doc)[:-3], "e"), (3, None, "e"), (4, "", "e"), (5, "[]", "e"), (6, "3", "e"), (7, '{"a": NaN}', "e"), (1, json.dumps(doc), "e")]
    df = spark.createDataFrame(rows, "record_id long, payload string, dewey string")
    nodes = shred(df, "record_id", "payload")
    kids = flat_table(df, "record_id", "payload", rf"\.{ALT}(\[\])?$", ["scheme", "label"], ["sequence_number"])
    out = kids.select("record_id", "parent_sequence_number", "position", "scheme", "label").distinct()
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1, "5", 1, "BW", "1.50"), (1, "6", 0, "S", "x"), (1, None, 0, "BW", "2.50")]
    # the same rows by a join of the node table on the truncated label
    lone = F.col("schema_path").endswith(ALT)
    own = schema_table(nodes, rf"\.{ALT}(\[\])?$", ["scheme", "label"]).withColumn("up", parent(F.col("dewey"), F.when(lone, 1).otherwise(2)))
    owners = schema_table(nodes, r"naming\[\]$", ["sequence_number"]).select("record_id", F.col("dewey").alias("up"), "sequence_number")
    joined = own.join(owners.distinct(), ["record_id", "up"], "left").select("record_id", "dewey", F.col("up").alias("parent_dewey"), "sequence_number", "scheme", "label")
    assert sorted(map(str, joined.distinct().collect())) == sorted(map(str, kids.select("record_id", "dewey", "parent_dewey", F.col("parent_sequence_number").alias("sequence_number"), "scheme", "label").distinct().collect()))
    assert {r[0] for r in nodes.select("record_id").collect()} == {1, 5, 6} - {5}
    residues = schema_table(nodes.where("record_id = 1"), r"naming\[\]$", ["sequence_number", "missing"]).distinct()
    assert sorted((r["sequence_number"] or "", r["missing"]) for r in residues.collect()) == [("", None), ("5", None), ("6", None)]


def test_truncation(spark):
    df = spark.sql("select array(0, 3, 1) as d, array() as e").select(dewey_text(parent(F.col("d"))).alias("a"), dewey_text(parent(F.col("d"), 2)).alias("b"), F.size(parent(F.col("e").cast("array<int>"))).alias("c"))
    assert tuple(df.first()) == ("0.3", "0", 0)


def test_whole_numbers(spark):
    texts = ["12", "-1", " 7 ", "3.0", "3.5", "x", "", None, "99999999999", "true"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(as_int(F.col("t"))).collect()]
    assert out == [12, -1, 7, 3, None, None, None, None, None, None]


def test_deep_and_long():
    deep = "[" * 50_000 + "]" * 50_000
    assert label_nodes(deep) is None or label_nodes(deep) == []
    assert len(label_nodes(json.dumps({"a": ["x" * 1_000_000] * 3}))) == 4


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=2), c, max_size=3), max_leaves=15))
def test_every_label_is_unique_and_has_its_parent(value):
    nodes = label_nodes(json.dumps(value))
    labels = [tuple(n[0]) for n in nodes]
    assert len(set(labels)) == len(labels)
    for label, path, kind, fields in nodes:
        at = value
        for i in label:
            at = list(at.values())[i] if isinstance(at, dict) else at[i]
        assert (kind == "object") == isinstance(at, dict)
        assert path.count("[]") <= len(label)
        assert kind != "object" or {k for k, _ in fields} == {k for k, v in at.items() if not isinstance(v, (dict, list))}
