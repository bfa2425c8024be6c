"""Atoms, bonded terms and selections as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.scalars import LETTERS

FIELDS = {"resname": "res_name", "name": "atom_name", "resseq": "res_seq", "resid": "res_seq", "chainid": "chain_id", "element": "element", "index": "atom_index"}
NUMERIC = {"res_seq", "atom_index"}
_TOKENS = re.compile(r"\(|\)|[^\s()]+")


def select(text: str) -> Column:
    """A selection as a predicate over atoms.

    Grammar: ``protein``, ``all``, ``FIELD VALUE...`` (values may be ranges ``a to b`` or ``a:b`` for numbers), ``not``,
    ``and``, ``or``, parentheses. Anything else raises ValueError; ``around`` is a join, see vectors.within.
    """
    tokens = _TOKENS.findall(text)
    pos = 0

    def peek() -> str:
        return tokens[pos].lower() if pos < len(tokens) else ""

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"selection ends early: {text!r}")
        pos += 1
        return tokens[pos - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while peek() == "and":
            take()
            out = out & one()
        return out

    def one() -> Column:
        word = take()
        low = word.lower()
        if low == "not":
            return ~one()
        if low == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"missing parenthesis: {text!r}")
            return out
        if low == "all":
            return F.lit(True)
        if low == "protein":
            return F.col("res_name").isin(*LETTERS)
        if low not in FIELDS:
            raise ValueError(f"unknown word {word!r} in selection {text!r}")
        column = FIELDS[low]
        values, ranges = [], []
        while peek() and peek() not in ("and", "or", "not", ")", "("):
            v = take()
            if column in NUMERIC:
                low_end, _, high = v.partition(":")
                if not high and peek() == "to":
                    take()
                    high = take()
                try:
                    (ranges if high else values).append((int(low_end), int(high)) if high else int(low_end))
                except ValueError:
                    raise ValueError(f"{word} needs whole numbers: {text!r}") from None
            else:
                values.append(v)
        if not values and not ranges:
            raise ValueError(f"{word} needs values: {text!r}")
        out = F.col(column).isin(*values) if values else F.lit(False)
        for a, b in ranges:
            out = out | F.col(column).between(a, b)
        return out

    result = either()
    if pos != len(tokens):
        raise ValueError(f"words left over in selection {text!r}")
    return result


def slice_vector(xyz: Column, atoms: Sequence[int]) -> Column:
    """Coordinates of the atoms from a flat array of three numbers each."""
    return F.flatten(F.transform(F.array(*[F.lit(a) for a in atoms]), lambda a: F.slice(xyz, a * 3 + 1, F.lit(3))))


def append_with_offset(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables; the second's index columns (ints or arrays of ints) are moved up by the first's row count."""
    n = F.broadcast(first.agg(F.count("*").alias("_n")))
    kinds = dict(second.dtypes)
    moved = {c: F.transform(c, lambda x: x + F.col("_n")) if kinds[c].startswith("array") else F.col(c) + F.col("_n") for c in columns}
    return first.unionByName(second.crossJoin(n).withColumns(moved).drop("_n"))


def remap_terms(terms: DataFrame, members: str, mapping: DataFrame) -> DataFrame:
    """Index tuples rewritten by the mapping (old, new); terms with an unmapped member are dropped."""
    rows = terms.select("term_id", F.posexplode(members).alias("_p", "old"))
    found = rows.join(mapping, "old").groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("_p", "new"))).alias("_m"))
    return terms.join(found, "term_id").where(F.size("_m") == F.size(members)).withColumn(members, F.transform("_m", lambda x: x["new"])).drop("_m")


def spread_charge(atoms: DataFrame, group: str, charge: str) -> DataFrame:
    """Charges corrected by equal shares so that each group's sum is whole."""
    w = Window.partitionBy(group)
    total = F.sum(charge).over(w)
    return atoms.withColumn(charge, F.col(charge) + (F.round(total) - total) / F.count("*").over(w))


def repartition_mass(atoms: DataFrame, bonds: DataFrame, to: float) -> DataFrame:
    """Hydrogens raised to mass ``to`` at the cost of the heavy atom they are bonded to; the total stays.

    atoms: idx, element, mass; bonds: i, j (each bond once, in either order).
    """
    both = bonds.select("i", "j").unionByName(bonds.select(F.col("j").alias("i"), F.col("i").alias("j")))
    h = atoms.where("element = 'H'").select(F.col("idx").alias("i"), (F.lit(to) - F.col("mass")).alias("gain"))
    pairs = both.join(h, "i").join(atoms.where("element != 'H'").select(F.col("idx").alias("j")), "j")
    moves = pairs.select(F.col("i").alias("idx"), F.col("gain").alias("d")).unionByName(pairs.select(F.col("j").alias("idx"), (-F.col("gain")).alias("d")))
    return atoms.join(moves.groupBy("idx").agg(F.sum("d").alias("_d")), "idx", "left").withColumn("mass", F.col("mass") + F.coalesce("_d", F.lit(0.0))).drop("_d")


def outside_box(atoms: DataFrame, inner: Column, pad: float, residue: Sequence[str]) -> DataFrame:
    """Residues with any atom outside the padded bounding box of the inner atoms."""
    axes = ("x", "y", "z")
    box = atoms.where(inner).agg(*[f(c).alias(f"_{c}{k}") for c in axes for k, f in ((0, F.min), (1, F.max))])
    out = F.lit(False)
    for c in axes:
        out = out | (F.col(c) < F.col(f"_{c}0") - pad) | (F.col(c) > F.col(f"_{c}1") + pad)
    return atoms.crossJoin(F.broadcast(box)).where(out).select(*residue).distinct()


def residues_around(atoms: DataFrame, inner: Column, radius: float, id_col: str, residue: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Whole residues with any atom within ``radius`` of an inner atom: the range join, then the residues it hits."""
    from tessellar.operators.vectors import within

    near = within(atoms, atoms.where(inner), id_col, axes, radius).select(F.col("j").alias(id_col)).distinct()
    return atoms.join(near, id_col, "left_semi").select(*residue).distinct()
