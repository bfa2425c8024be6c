"""Deeply nested records into related flat tables, linked by Dewey labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "record_id long, dewey array<int>, schema_path string, kind string, fields map<string,string>"
_ARROW = pa.schema([("record_id", pa.int64()), ("dewey", pa.list_(pa.int32())), ("schema_path", pa.string()), ("kind", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
BATCH_NODES = 20_000


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _scalar(value: object) -> str | None:
    """A scalar's text; its JSON type stays visible: only booleans give true and false, only null gives null."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def label_nodes(text: str | None) -> list[tuple[list[int], str, str, list[tuple[str, str | None]]]] | None:
    """(Dewey label, schema path, kind, scalar fields) of every object and array element; None if it isn't JSON.

    A node's label is its parent's with its ordinal among the parent's members appended; array places count from 0,
    empty ones too. Scalars directly in an object are its fields; a scalar element of an array is a node of its own.
    Works without recursion, so depth is bounded by the JSON reader alone.
    """
    try:
        root = json.loads(text, parse_constant=_no_constant) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if text is None:
        return None
    out, stack = [], [((), "$", root)]
    while stack:
        dewey, path, value = stack.pop()
        if isinstance(value, dict):
            out.append((dewey, path, "object", [(k, _scalar(v)) for k, v in value.items() if not isinstance(v, (dict, list))]))
            stack += [((*dewey, i), f"{path}.{k}", v) for i, (k, v) in enumerate(value.items()) if isinstance(v, (dict, list))]
        elif isinstance(value, list):
            stack += [((*dewey, i), f"{path}[]", v) for i, v in enumerate(value)]
        else:
            out.append((dewey, path, "scalar", [("value", _scalar(value))]))
    return out


def shred(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All nodes of all records: record_id, dewey, schema_path, kind, fields.

    One narrow pass; a payload that is null, cut off or not JSON gives no rows. Extra columns are ignored and repeated
    records each give their nodes. Memory holds one record and one output batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(rid, *node) for node in label_nodes(text) or ()]
                if len(rows) >= BATCH_NODES:
                    yield _as_batch(rows)
                    rows = []
            if rows:
                yield _as_batch(rows)

    return records.select(id_col, json_col).mapInArrow(run, SCHEMA)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def parent(dewey: Column, levels: int | Column = 1) -> Column:
    """The ancestor's label: truncation."""
    return F.slice(dewey, F.lit(1), F.greatest(F.size(dewey) - levels, F.lit(0)))


def dewey_text(dewey: Column) -> Column:
    return F.array_join(dewey.cast("array<string>"), ".")


def schema_table(nodes: DataFrame, pattern: str, fields: list[str], kind: str = "object") -> DataFrame:
    """The flat table of the nodes whose schema path matches: record_id, dewey, schema_path, then the fields as strings.

    A field that a node lacks, or that holds an object or array there, is null.
    """
    chosen = nodes.where((F.col("kind") == kind) & F.col("schema_path").rlike(pattern))
    return chosen.select("record_id", "dewey", "schema_path", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in fields])


def as_int(text: Column) -> Column:
    """An int written as a JSON number or as digits in a string; anything else is null."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+(\.0+)?$"), F.trim(text).try_cast("double").try_cast("long").try_cast("int"))


def flat_table(records: DataFrame, id_col: str, json_col: str, pattern: str, fields: Sequence[str], parent_fields: Sequence[str] = (), having: Sequence[str] = ()) -> DataFrame:
    """One schema table straight from the records, with fields of each node's parent beside its own, in one pass.

    The nodes whose schema path matches ``pattern`` (and that have one of ``having``, if any are named): record_id, dewey,
    parent_dewey, position, schema_path, the fields and ``parent_<field>`` as strings, null where there is none. The parent
    is the object that the node's label leads to by truncation: one level for a lone object, two for an element of an
    array; position is the element's place, 0 for a lone object. The nodes of a record come from one row, so the link is
    looked up by the truncated label among that record's own nodes, and nothing is shuffled. Records as in ``shred``.
    """
    fields, parent_fields, wanted = list(fields), list(parent_fields), re.compile(pattern)
    names = [*fields, *(f"parent_{f}" for f in parent_fields)]
    schema = pa.schema(
        [("record_id", pa.int64()), ("dewey", pa.list_(pa.int32())), ("parent_dewey", pa.list_(pa.int32())), ("position", pa.int32()), ("schema_path", pa.string()), *((n, pa.string()) for n in names)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = lru_cache(maxsize=100_000)(lambda path: wanted.search(path) is not None)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _matching(rid, text, matches, fields, parent_fields, having):
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                if len(columns[0]) >= BATCH_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    columns = [[] for _ in schema]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    types = "record_id long, dewey array<int>, parent_dewey array<int>, position int, schema_path string"
    return records.select(id_col, json_col).mapInArrow(run, ", ".join([types, *(f"`{n}` string" for n in names)]))


def _matching(rid: int, text: str | None, matches: Callable[[str], bool], fields: list[str], parent_fields: list[str], having: Sequence[str]) -> Iterator[tuple]:
    if text is None:
        return
    try:
        root = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return
    objects: dict[tuple[int, ...], dict] = {}  # by label, of the objects that a node could be linked to
    stack: list[tuple[tuple[int, ...], str, object]] = [((), "$", root)]
    while stack:
        dewey, path, value = stack.pop()
        if isinstance(value, dict):
            objects[dewey] = value
            for i, (k, v) in enumerate(value.items()):
                if isinstance(v, (dict, list)):
                    stack.append(((*dewey, i), f"{path}.{k}", v))
            if not matches(path) or (having and not any(h in value and not isinstance(value[h], (dict, list)) for h in having)):
                continue
            own = [None if isinstance(x := value.get(f), (dict, list)) else _scalar(x) for f in fields]
            element = path.endswith("[]")
            above = dewey[: -2 if element else -1]
            parent = objects.get(above, {}) if dewey else {}
            carried = [None if isinstance(x := parent.get(f), (dict, list)) else _scalar(x) for f in parent_fields]
            yield rid, dewey, above, dewey[-1] if element else 0, path, *own, *carried
        elif isinstance(value, list):
            stack += [((*dewey, i), f"{path}[]", v) for i, v in enumerate(value) if isinstance(v, (dict, list))]
