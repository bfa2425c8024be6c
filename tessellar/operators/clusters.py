"""Density clusters of points, on cells instead of pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.session import discard, materialise


def components(edges: DataFrame, nodes: DataFrame, most: int = 64) -> DataFrame:
    """node, component (the smallest node in reach) of an undirected graph; edges: a, b in both directions.

    Each round takes the smallest label among the neighbours and then follows the label's own label, so the rounds grow
    with the logarithm of the longest chain. Every round is written to the shared folder: lineage stays short, and
    neither labels nor links reach the driver.
    """
    current = materialise(nodes.select("node", F.col("node").alias("component")), "labels")
    for _ in range(most):
        labels = current.select("node", "component")
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("_m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("component", F.coalesce("_m", "component")).alias("component"), F.col("component").alias("_old"))
        jump = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = materialise(step.join(jump, step.component == jump["_n"], "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "_old"), "labels")
        discard(current)
        current = new
        if not new.where("component != _old").limit(1).count():
            return new.select("node", "component")
    raise RuntimeError(f"components not found in {most} rounds")


def density_clusters(points: DataFrame, id_col: str, axes: Sequence[str], side: float, least: int) -> DataFrame:
    """id, cluster: points in cells of the given side that hold at least ``least`` points, neighbouring cells together.

    Points in thinner cells, or with a null coordinate, have no cluster. A cell that holds a third of all points is one
    row of the graph: counts are combined before the shuffle, and no pair of points is ever formed.
    """
    key = F.concat_ws(",", *[F.floor(F.col(a) / side).cast("string") for a in axes])
    whole = F.lit(True)
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    placed = points.select(F.col(id_col), F.when(whole, key).alias("_cell"))
    dense = materialise(placed.where("_cell is not null").groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col("_cell").alias("node")), "cells")
    shifts = [s for s in product((-1, 0, 1), repeat=len(axes)) if any(s)]
    parts = F.split("node", ",")
    around = F.array(*[F.concat_ws(",", *[(parts[k].cast("long") + s).cast("string") for k, s in enumerate(shift)]) for shift in shifts])
    edges = dense.select(F.col("node").alias("a"), F.explode(around).alias("b")).join(dense.select(F.col("node").alias("b")), "b")
    found = components(materialise(edges.select("a", "b"), "edges"), dense)
    return placed.join(found.select(F.col("node").alias("_cell"), F.col("component").alias("cluster")), "_cell", "left").select(id_col, "cluster")
