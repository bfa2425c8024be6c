"""Entity, attribute, value rows into one row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTRIBUTES = 4096


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table: its place from 1, the attribute's value in the rows, the column's name and type."""

    position: int
    key: str
    name: str
    type: str = "double"


def supplied_cells(rows: DataFrame, keys: Sequence[str], value: str, when: str, tiebreak: str) -> DataFrame:
    """One row per key: the value with the latest ``when``, on equal times that of the smallest ``tiebreak``.

    Rows with a null key or value are left out; a null time counts as earlier than any. Repeated rows change nothing. The
    maximum is combined before the shuffle, so a key that holds a third of the rows sends one row per task.
    Null keys are dropped by the aggregate's result, not by a filter on the keys: such a filter would be pushed below the
    aggregation and repeat the whole expression that a key is worked out by.
    Result: keys, value, tiebreak.
    """
    usable = rows.where(F.col(value).isNotNull())
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    best = F.max(F.when(named, F.struct(F.col(when).alias("t"), (-F.col(tiebreak)).alias("n"), F.col(value).alias("v"))))
    hashed = F.xxhash64(*keys).alias("_h")  # sorted by a number first, not by long common prefixes
    cells = usable.groupBy(hashed, *keys).agg(best.alias("b")).where("b is not null")
    return cells.select(*keys, F.col("b.v").alias(value), (-F.col("b.n")).alias(tiebreak))


def attribute_grid(rows: DataFrame, entity: str, attribute: str, value: str, when: str, tiebreak: str, panel: Sequence[Attribute]) -> DataFrame:
    """Every entity with its complete row of the grid: an array of (pos, value, source) sorted by attribute position.

    The grid is complete: each entity has an entry for each panel attribute, with nulls where no row supplies a value,
    and an entity without any value still has its row (null entities have none). What is shuffled is at most one cell
    per entity and attribute, combined before; an entity's cells are collected (at most one an attribute), the positions
    it lacks are added inside its own row, so the entity-by-attribute product never crosses the network, and the array is
    sorted by position: the i-th entry is the i-th attribute's. An empty panel gives empty arrays.
    """
    if len(panel) > MAX_ATTRIBUTES:
        raise ValueError(f"a panel of {len(panel)} attributes; at most {MAX_ATTRIBUTES} become columns")
    positions = F.create_map(*[F.lit(x) for a in panel for x in (a.key, a.position)]) if panel else F.lit(None).cast("map<string,int>")
    pos = F.try_element_at(positions, F.coalesce(F.col(attribute), F.lit("")))
    known = rows.select(F.col(entity).alias("e"), F.when(F.col(value).isNotNull(), pos).alias("p"), F.col(value).alias("v"), F.col(when).alias("t"), F.col(tiebreak).alias("n"))
    filled = F.when(F.col("p").isNotNull(), F.struct("t", (-F.col("n")).alias("n"), "v"))
    here = F.max(F.when(F.col("e").isNotNull(), 1))  # null entities go by the aggregate, as in supplied_cells
    cells = known.groupBy(F.xxhash64("e", "p").alias("h"), "e", "p").agg(F.max(filled).alias("b"), here.alias("here")).where("here = 1")
    entry = F.when(F.col("p").isNotNull(), F.struct(F.col("p").alias("pos"), F.col("b.v").alias("value"), (-F.col("b.n")).alias("source")))
    held = cells.groupBy("e").agg(F.collect_list(entry).alias("held"))
    places = F.array(*[F.lit(a.position) for a in panel]).cast("array<int>")
    kinds = {f.name: f.dataType for f in rows.schema}
    empty = F.transform(F.array_except(places, F.col("held.pos")), lambda p: F.struct(p.alias("pos"), F.lit(None).cast(kinds[value]).alias("value"), F.lit(None).cast(kinds[tiebreak]).alias("source")))
    return held.select(F.col("e").alias(entity), F.sort_array(F.concat("held", empty)).alias("grid"))


def _ordered(panel: Sequence[Attribute]) -> list[Attribute]:
    return sorted(panel, key=lambda a: a.position)


def _value(i: int, a: Attribute) -> Column:
    """The grid's i-th place in its column's type; a value that the type can't hold becomes null."""
    return F.col("grid")[i]["value"].try_cast(a.type)


def project_panel(grid: DataFrame, entity: str, panel: Sequence[Attribute]) -> DataFrame:
    """The grid's fixed places as columns; a value that its column's type can't hold becomes null."""
    return grid.select(entity, *[_value(i, a).alias(a.name) for i, a in enumerate(_ordered(panel))])


def filled_cells(grid: DataFrame, entity: str, attribute: str, tiebreak: str, panel: Sequence[Attribute]) -> DataFrame:
    """The cells of the projected table that hold a value, as rows: entity, attribute, source row."""
    if not panel:
        return grid.where("false").select(entity, F.lit("").alias(attribute), F.lit(0).cast("long").alias(tiebreak))
    names = [f"_{i}" for i in range(len(panel))]
    sources = [F.when(_value(i, a).isNotNull(), F.col("grid")[i]["source"]).alias(n) for (i, a), n in zip(enumerate(_ordered(panel)), names, strict=True)]
    long = grid.select(F.col(entity).alias("_e"), *sources).unpivot("_e", names, "_p", "_s").where("_s is not null")
    keys = F.array(*[F.lit(a.key) for a in _ordered(panel)])
    return long.select(F.col("_e").alias(entity), keys[F.substring("_p", 2, 9).cast("int")].alias(attribute), F.col("_s").alias(tiebreak))
