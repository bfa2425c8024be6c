"""Queries of the general training-data operators: p1 wide tables, p3 failing rows, p5 nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.labels import canonical_system, with_canonical_contact
from tessellar.operators import badrows, nested, wide
from tessellar.session import table

FREQUENCY_KEY = ("frequency", "loaded_at", "row_id")


MAX_TYPES = 10_000


def few(df: DataFrame, most: int, what: str) -> list:
    """All rows of a small table; more than ``most`` is an error, not a cut."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def contact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all_contacts in canonical spelling; frequency is null where it is unusable."""
    f = F.col("frequency")
    rows = with_canonical_contact(table(spark, sf_dir, "all_contacts"), "contact", "contact", "res1", "res2")
    return rows.select(
        "contact",
        canonical_system(F.col("system")).alias("system"),
        F.when(~F.isnan(f) & f.between(0, 1), f).alias("frequency"),
        "loaded_at",
        "row_id",
    )


def panel(spark: SparkSession, sf_dir: str) -> list[wide.Attribute]:
    """The panel's systems; their number is fixed and checked by the operator."""
    rows = table(spark, sf_dir, "panel_systems").orderBy("col_no").take(wide.MAX_ATTRIBUTES + 1)
    return [wide.Attribute(r["col_no"], r["system"], r["system"]) for r in rows]


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[wide.Attribute]]:
    columns = panel(spark, sf_dir)
    return wide.attribute_grid(contact_values(spark, sf_dir), "contact", "system", "frequency", "loaded_at", "row_id", columns), columns


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, columns = _grid(spark, sf_dir)
    return wide.filled_cells(grid, "contact", "system", "row_id", columns)


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, columns = _grid(spark, sf_dir)
    return wide.project_panel(grid, "contact", columns)


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [r[0] for r in few(table(spark, sf_dir, "interaction_types").select("itype"), MAX_TYPES, "interaction types")]
    return badrows.load_lines(table(spark, sf_dir, "a3_contacts_raw"), known)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.failing_rows(_loaded(spark, sf_dir))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.sound_rows(_loaded(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = nested.flat_table(table(spark, sf_dir, "naming_cache"), "record_id", "payload", r"\.alternative_generic_numbers(\[\])?$", ["scheme", "label"], ["sequence_number"])
    return (
        kids.where("scheme != '' and label != ''")
        .select("record_id", nested.as_int(F.col("parent_sequence_number")).alias("sequence_number"), F.col("position").alias("alt_pos"), "scheme", "label")
        .where("sequence_number is not null")
        .distinct()
    )


def p5_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per residue with its Dewey label, the label of the object that holds it, and its own fields."""
    own = ["sequence_number", "amino_acid"]
    rows = nested.flat_table(table(spark, sf_dir, "naming_cache"), "record_id", "payload", ".", own, having=own)
    return rows.select(
        "record_id",
        nested.as_int(F.col("sequence_number")).alias("sequence_number"),
        F.nullif("amino_acid", F.lit("")).alias("amino_acid"),
        nested.dewey_text(F.col("dewey")).alias("dewey"),
        nested.dewey_text(nested.parent(F.col("dewey"))).alias("parent_dewey"),
        "schema_path",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_wide": p1_wide,
    "p3_found": p3_found,
    "p3_rows": p3_rows,
    "p5_found": p5_found,
    "p5_residues": p5_residues,
}
