"""Force-field files: sections of elements with attributes, written from tables and read back by element."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """One section of the file: its element, the element of its entries, and their rows with the attributes in order."""

    name: str
    entry: str
    rows: DataFrame
    attributes: Sequence[str]


def _escaped(value: Column) -> Column:
    out = value.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def xml_lines(sections: Sequence[Section], root: str = "ForceField") -> DataFrame:
    """(section, line, value): the file's text, in the order of section and line. Null attributes are left out.

    Lines are made where the rows are; entries of a section come in the order of their attributes' text.
    """
    spark = sections[0].rows.sparkSession
    frame = [(-1, 0, "", f"<{root}>"), *((k, -1, "", f"  <{s.name}>") for k, s in enumerate(sections)), *((k, 1, "", f"  </{s.name}>") for k, s in enumerate(sections)), (len(sections), 0, "", f"</{root}>")]
    out = spark.createDataFrame(frame, "section int, part int, line string, value string")
    for k, s in enumerate(sections):
        named = [F.when(F.col(a).isNotNull(), F.concat(F.lit(f'{a}="'), _escaped(F.col(a)), F.lit('"'))) for a in s.attributes]
        text = F.concat(F.lit(f"    <{s.entry} "), F.concat_ws(" ", *named), F.lit("/>"))
        out = out.unionByName(s.rows.select(F.lit(k).alias("section"), F.lit(0).alias("part"), text.alias("line"), text.alias("value")))
    return out


def write_xml(sections: Sequence[Section], path: str) -> None:
    """One file; its entries are sorted by range and gathered in order only as text lines."""
    xml_lines(sections).orderBy("section", "part", "line").select("value").coalesce(1).write.text(path)


def read_entries(spark: SparkSession, path: str, entry: str, schema: str) -> DataFrame:
    """The entries of one element as rows; the schema's columns are the attributes' names with a leading underscore."""
    return spark.read.format("xml").option("rowTag", entry).schema(schema).load(path)
