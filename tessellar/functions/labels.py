"""Canonical spellings of contacts, systems, residues and atoms, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters counted as blanks in labels.
_BLANK = r"(?U)[\s\uFEFF]"


_EDGES = " \t\r\n\f\v\u00a0"


def trimmed(col: Column) -> Column:
    """Without blanks at either end."""
    return F.btrim(col, F.lit(_EDGES))


def squeezed(col: Column) -> Column:
    """Upper case without any blank; null for what is null or has nothing left."""
    up = F.upper(col)
    return F.nullif(F.when(up.rlike(_BLANK), F.regexp_replace(up, _BLANK + "+", "")).otherwise(up), F.lit(""))


def with_canonical_contact(rows: DataFrame, name: str, contact: str, res1: str, res2: str) -> DataFrame:
    """Adds both residue labels in upper case without blanks, the smaller first, joined by one hyphen.

    A null or blank contact follows from res1 and res2; null if that is impossible. The hyphen between the labels is the
    last before the third colon, ``chain:name:number-chain:name:number``, so a residue number may be negative. The steps are
    columns of their own, so that each is worked out once a row.
    """
    out = rows.withColumn("_s", squeezed(F.col(contact)))
    head = F.substring_index("_s", ":", 3)
    cut = F.length(head) - F.length(F.substring_index(head, "-", -1)) - 1
    out = out.withColumn("_n", F.when(F.length("_s") - F.length(F.replace("_s", F.lit(":"), F.lit(""))) == 4, cut))
    first = F.when(F.col("_s").isNull(), squeezed(F.col(res1))).when(F.col("_n") > 0, F.substring("_s", F.lit(1), F.col("_n")))
    second = F.when(F.col("_s").isNull(), squeezed(F.col(res2))).when(F.col("_n") > 0, F.substring("_s", F.col("_n") + 2, F.length("_s")))
    out = out.withColumns({"_a": first, "_b": second})
    joined = F.when(F.col("_a") <= F.col("_b"), F.concat("_a", F.lit("-"), "_b")).otherwise(F.concat("_b", F.lit("-"), "_a"))
    return out.withColumn(name, joined).drop("_s", "_n", "_a", "_b")


def canonical_system(system: Column) -> Column:
    """The system's name alone (letters, digits, ``_R``, digits) in upper case; null if there is none."""
    return F.nullif(F.regexp_extract(squeezed(system), r"(?:^|[^A-Z0-9])([A-Z]+[0-9]+_R[0-9]+)(?![A-Z0-9])", 1), F.lit(""))


def residue_of(atom: Column) -> Column:
    """``chain:resname:number`` of an atom label; null with fewer than three parts."""
    return F.when(F.length(atom) - F.length(F.replace(atom, F.lit(":"), F.lit(""))) >= 2, F.substring_index(atom, ":", 3))


def part(label: Column, i: int) -> Column:
    return F.try_element_at(F.split(label, ":"), F.lit(i))


def residue_number(label: Column) -> Column:
    return part(label, 3).try_cast("int")


def atom_class(name: Column) -> Column:
    """First of the letters N, O, S, P, C that the name starts with, else X."""
    letter = F.upper(F.substring(F.trim(name), 1, 1))
    return F.when(letter.isin("N", "O", "S", "P", "C"), letter).otherwise("X")


def undirected_token(itype: Column, endpoints: Column) -> Column:
    """Interaction type and the sorted distinct endpoints, joined by pipes; null under two distinct endpoints."""
    ends = F.sort_array(F.array_distinct(endpoints))
    return F.when(F.size(ends) >= 2, F.concat_ws("|", itype, F.array_join(ends, "|")))
