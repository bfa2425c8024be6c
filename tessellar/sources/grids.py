"""Scalar grids in the DX text format, C order (k fastest)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dx_lines(grid: DataFrame, origin: Sequence[float], spacing: Sequence[float], counts: Sequence[int], per_line: int = 3) -> DataFrame:
    """(line_no, value) of the grid's text, three values a line."""
    n = counts[0] * counts[1] * counts[2]
    head = [
        f"object 1 class gridpositions counts {counts[0]} {counts[1]} {counts[2]}",
        f"origin {origin[0]} {origin[1]} {origin[2]}",
        f"delta {spacing[0]} 0 0",
        f"delta 0 {spacing[1]} 0",
        f"delta 0 0 {spacing[2]}",
        f"object 2 class gridconnections counts {counts[0]} {counts[1]} {counts[2]}",
        f"object 3 class array type double rank 0 items {n} data follows",
    ]
    flat = (F.col("i") * counts[1] + F.col("j")) * counts[2] + F.col("k")
    rows = grid.select(flat.alias("f"), "val").withColumn("line_no", F.floor(F.col("f") / per_line) + len(head))
    body = rows.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "val"))), lambda x: x["val"].cast("string")), " ").alias("value"))
    top = grid.sparkSession.createDataFrame(list(enumerate(head)), "line_no long, value string")
    return top.unionByName(body)


def write_dx(grid: DataFrame, origin: Sequence[float], spacing: Sequence[float], counts: Sequence[int], path: str, compressed: bool = False) -> None:
    """The grid's text as one file, gzipped if wanted; the format has one file a grid, whose size the counts bound."""
    lines = dx_lines(grid, origin, spacing, counts).orderBy("line_no").select("value").coalesce(1)
    lines.write.option("compression", "gzip" if compressed else "none").text(path)


def read_dx(spark: SparkSession, path: str) -> DataFrame:
    """As parse_dx, of a file that ``write_dx`` or another program wrote; a name ending in .gz is unpacked."""
    text = spark.read.text(path, wholetext=True)
    return parse_dx(spark, text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")))


def parse_dx(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """i, j, k, x, y, z, val of numbered lines; the header is a few short lines, the values may fill the lines unevenly.

    The coordinates follow from the origin and the three deltas in the header.
    """
    v = F.col("value")
    header = [r["value"].split() for r in lines.where(v.rlike(r"^\s*(origin|delta)|gridpositions")).orderBy("line_no").take(100)]
    counts = next([int(x) for x in h[-3:]] for h in header if "gridpositions" in h)
    origin = next([float(x) for x in h[1:4]] for h in header if h[0] == "origin")
    deltas = [[float(x) for x in h[1:4]] for h in header if h[0] == "delta"][:3]
    body = lines.where(~v.rlike(r"^\s*(object|origin|delta|attribute|component|#|$)")).select("line_no", F.split(F.trim(v), r"\s+").alias("x"))
    from tessellar.operators.reshape import range_index

    placed = range_index(body.select("line_no", F.posexplode("x").alias("p", "val")), ["line_no", "p"])
    j, k = counts[1], counts[2]
    f = F.col("frame")
    at = placed.select(F.floor(f / (j * k)).alias("i"), (F.floor(f / k) % j).alias("j"), (f % k).alias("k"), F.col("val").cast("double").alias("val"))
    axes = [sum((F.col(c) * F.lit(d[a]) for c, d in zip("ijk", deltas, strict=True)), F.lit(origin[a])).alias(n) for a, n in enumerate("xyz")]
    return at.select("i", "j", "k", *axes, "val")


def match_subgrid(part: DataFrame, grid: DataFrame, origin: Sequence[float], spacing: Sequence[float], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Each point of the part with the grid's point of the same coordinates: the part's columns, then i, j, k of the grid.

    Coordinates become whole steps from the origin, which are compared, never the doubles. Raises unless every point has
    exactly one match. grid: i, j, k.
    """
    step = [F.round((F.col(a) - o) / s).cast("bigint").alias(f"_{c}") for a, o, s, c in zip(axes, origin, spacing, "ijk", strict=True)]
    placed = part.select("*", *step)
    out = placed.join(grid.select(*[F.col(c).cast("bigint").alias(f"_{c}") for c in "ijk"], "i", "j", "k"), ["_i", "_j", "_k"], "left")
    bad = out.groupBy(*part.columns).agg(F.count("i").alias("n")).where("n != 1").limit(1).count()
    if bad:
        raise ValueError("a point of the part has no match or several in the grid")
    return out.drop("_i", "_j", "_k")
