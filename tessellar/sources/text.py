"""Line-based sources: contact logs, fixed-width atom records, docking scores, sequences, mmCIF loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def contact_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """frame, itype, atoms of each line with at least four fields between blanks; blank lines and comments are skipped."""
    text = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    fields = F.split(text, r"\s+")
    kept = lines.where((text != "") & ~text.startswith("#")).withColumn("_f", fields).where(F.size("_f") >= 4)
    return kept.withColumns({"frame": F.col("_f")[0], "itype": F.col("_f")[1], "atoms": F.slice("_f", F.lit(3), F.size("_f"))}).drop("_f", line)


def read_contact_tables(spark: SparkSession, paths: Sequence[str], columns: str) -> DataFrame:
    """Tab-separated files with ``#`` comments and bad lines dropped, each row tagged with its file's system."""
    df = spark.read.csv(list(paths), sep="\t", comment="#", mode="DROPMALFORMED", schema=columns)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(_frequencies)?\.tsv$", "")
    return df.select("*", name.alias("system"))


def _cut(line: Column, a: int, b: int) -> Column:
    return F.nullif(F.trim(F.substring(line, a, b - a + 1)), F.lit(""))


def atom_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fixed-width ATOM and HETATM records; a number that can't be read is null."""
    v = F.col(line)
    return lines.where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM")).select(
        F.trim(F.substring(v, 1, 6)).alias("record"),
        _cut(v, 7, 11).try_cast("int").alias("serial"),
        _cut(v, 13, 16).alias("atom_name"),
        _cut(v, 18, 21).alias("res_name"),
        _cut(v, 22, 22).alias("chain_id"),
        _cut(v, 23, 26).try_cast("int").alias("res_seq"),
        *[_cut(v, a, a + 7).try_cast("double").alias(n) for n, a in (("x", 31), ("y", 39), ("z", 47))],
        _cut(v, 77, 78).alias("element"),
    )


# Residue names by class.
MEMBRANE = ("POP", "POPC", "DOPC", "CHL", "CLR")
SOLVENT = ("HOH", "WAT", "NA", "CL", "SOD", "CLA")


def atom_kind(res_name: Column, element: Column) -> Column:
    """First class that fits: solvent, membrane, hydrogen, protein or ligand heavy atom."""
    from tessellar.functions.scalars import LETTERS, residue_name

    return F.when(res_name.isin(*SOLVENT), "solvent").when(res_name.isin(*MEMBRANE), "membrane").when(element == "H", "hydrogen").when(residue_name(res_name).isin(*LETTERS), "protein").otherwise("ligand")


def without_records(lines: DataFrame, line: str, *words: str) -> DataFrame:
    """Lines that don't contain all the words."""
    hit = F.lit(True)
    for w in words:
        hit = hit & F.col(line).contains(w)
    return lines.where(~hit)


def docking_scores(lines: DataFrame, line: str = "value") -> DataFrame:
    """The first number of each result remark."""
    return lines.where(F.col(line).contains("REMARK VINA RESULT")).select(F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(4)).try_cast("double").alias("score"))


def sequence_block(name: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">P1;"), name, F.lit("\nsequence:"), name, F.lit(":::::::0.00: 0.00\n"), sequence, F.lit("*\n"))


def cif_atoms(lines: DataFrame, columns: Sequence[str], line: str = "value") -> DataFrame:
    """Rows of an atom-site loop: blank-separated values in the loop's column order."""
    v = F.split(F.trim(line), r"\s+")
    rows = lines.where(F.col(line).rlike(r"^(ATOM|HETATM)\s")).withColumn("_v", v).where(F.size("_v") == len(columns))
    return rows.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(columns)])
