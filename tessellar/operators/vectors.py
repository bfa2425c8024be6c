"""Distances between vectors, points and frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 1_000, 20_000


def rms(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root mean squared difference of every row of a to every row of b, by one matrix product."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0) / max(a.shape[1], 1))


def periodic_rms(period: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """As rms, of differences on a circle."""

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        for i in range(len(a)):
            d = np.abs(a[i] - b) % period
            out[i] = np.sqrt((np.minimum(d, period - d) ** 2).mean(axis=1))
        return out

    return f


def blocked_pairs(rows: DataFrame, queries: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, n_rows: Callable[[], int], n_queries: Callable[[], int]) -> DataFrame:
    """The kernel's rows for every block of queries with every block of rows; both frames: id, v.

    Both sides are cut by a hash of the id, and each pair of blocks is one group, of about QUERY_BLOCK queries and ROW_BLOCK
    rows, however large the sides are.
    """
    nq, nr = max(1, -(-n_queries() // QUERY_BLOCK)), max(1, -(-n_rows() // ROW_BLOCK))

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(F.col("id").alias("id"), F.col("v").alias("v"), block("id", nq).alias("bq"), every(nr).alias("br"))
    right = rows.select("id", "v", every(nq).alias("bq"), block("id", nr).alias("br"))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b) if len(a) and len(b) else pd.DataFrame({n: np.empty(0) for n in names})

    return left.groupBy("bq", "br").cogroup(right.groupBy("bq", "br")).applyInPandas(meet, schema)


def blocked_distances(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, metric: Callable[[np.ndarray, np.ndarray], np.ndarray] = rms, n_rows: int | None = None, n_queries: int | None = None, nearest: int | None = None) -> DataFrame:
    """Distances of a stated query set to all rows: i (query), j, d; only the ``nearest`` of each query if given.

    Both sides are cut into blocks by a hash of the id, and each pair of blocks is one group: a numpy kernel works on at
    most about a thousand queries and twenty thousand rows, however large the sides are. Null vectors have no distances.
    With ``nearest`` each block pair keeps its best and the final choice is made among those.
    """
    r = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = metric(np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy()))
        i, j = a.id.to_numpy(), b.id.to_numpy()
        if nearest is not None and nearest < len(j):
            order = np.lexsort((np.broadcast_to(j, d.shape), d), axis=1)[:, :nearest]
            return pd.DataFrame({"i": np.repeat(i, nearest), "j": j[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})
        return pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "d": d.ravel()})

    out = blocked_pairs(r, q, pairs, "i long, j long, d double", lambda: n_rows if n_rows is not None else r.count(), lambda: n_queries if n_queries is not None else q.count())
    if nearest is None:
        return out
    from tessellar.operators.relational import first_per_group

    return first_per_group(out, ["i"], [F.asc("d"), F.asc("j")], nearest)


def within(points: DataFrame, queries: DataFrame, id_col: str, axes: Sequence[str], radius: float) -> DataFrame:
    """Pairs (i of the queries, j, d) at most ``radius`` apart: points meet only in neighbouring cells of that size."""
    cell = [F.floor(F.col(a) / radius).cast("long") for a in axes]
    p = points.na.drop(subset=[id_col, *axes]).select(F.col(id_col).alias("j"), *[F.col(a).alias(f"_p{k}") for k, a in enumerate(axes)], *[c.alias(f"_c{k}") for k, c in enumerate(cell)])
    shifts = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in product((-1, 0, 1), repeat=len(axes))])).alias("_s")
    q = queries.na.drop(subset=[id_col, *axes]).select(F.col(id_col).alias("i"), *[F.col(a).alias(f"_q{k}") for k, a in enumerate(axes)], *[c.alias(f"_b{k}") for k, c in enumerate(cell)], shifts)
    q = q.select("i", *[f"_q{k}" for k in range(len(axes))], *[(F.col(f"_b{k}") + F.col("_s")[k]).alias(f"_c{k}") for k in range(len(axes))])
    square = sum(((F.col(f"_p{k}") - F.col(f"_q{k}")) ** 2 for k in range(len(axes))), F.lit(0.0))
    return q.join(p, [f"_c{k}" for k in range(len(axes))]).withColumn("d", F.sqrt(square)).where(F.col("d") <= radius).select("i", "j", "d")


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, summed element by element before the shuffle."""
    parts = rows.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("p", "x"))
    means = parts.groupBy(group, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(rows: DataFrame, id_col: str, vector: str, centres: DataFrame, group: str, most: int = 1_000) -> DataFrame:
    """The closest centroid of each row, of equally close ones the smallest group: id, group, d.

    Up to ``most`` centroids are broadcast, as one row; more of them meet the rows in blocks instead, which needs groups
    that are whole numbers.
    """
    from tessellar.functions.scalars import rms_distance

    if centres.limit(most + 1).count() > most:
        kind = centres.schema[group].dataType
        found = blocked_distances(centres.withColumnRenamed(group, "_g"), rows.select(F.col(id_col).alias("_g"), F.col(vector).alias("centroid")), "_g", "centroid", nearest=1)
        return found.select(F.col("i").alias(id_col), F.col("j").cast(kind).alias(group), "d")
    listed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "centroid"))).alias("_c"))
    all_d = F.transform("_c", lambda c: F.struct(F.round(rms_distance(F.col(vector), c["centroid"]), 12).alias("d"), c["g"].alias("g")))
    return rows.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(listed)).select(id_col, F.array_min(all_d).alias("_m")).select(id_col, F.col("_m.g").alias(group), F.col("_m.d").alias("d"))


def pair_features(rows: DataFrame, id_col: str, xyz: str, n_atoms: int, pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Distances of all (or the given) atom pairs of each frame as one vector: id, features."""
    a, b = np.triu_indices(n_atoms, 1) if pairs is None else np.array(pairs, int).reshape(-1, 2).T

    def run(batches):
        for f in batches:
            x = np.stack(f.v.to_numpy())[:, : 3 * n_atoms].reshape(len(f), n_atoms, 3) if len(f) else np.zeros((0, n_atoms, 3))
            yield pd.DataFrame({id_col: f[id_col], "features": list(np.linalg.norm(x[:, a] - x[:, b], axis=2))})

    return rows.where(F.col(xyz).isNotNull()).select(id_col, F.col(xyz).cast("array<double>").alias("v")).mapInPandas(run, f"{id_col} long, features array<double>")


def close_pairs(frame: Sequence[float], cutoff: float) -> list[tuple[int, int]]:
    """Atom pairs of one frame at most ``cutoff`` apart."""
    x = np.asarray(frame, float).reshape(-1, 3)
    a, b = np.triu_indices(len(x), 1)
    near = np.linalg.norm(x[a] - x[b], axis=1) <= cutoff
    return list(zip(a[near].tolist(), b[near].tolist(), strict=True))


def weighted_sum(matrices: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """w1 d1 + w2 d2 + ... over the pairs (i, j) that all matrices have, in one aggregation."""
    tagged = None
    for m, w in matrices:
        part = m.select("i", "j", (F.col("d") * w).alias("d"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("i", "j").agg(F.sum("d").alias("d"), F.count("*").alias("_n")).where(F.col("_n") == len(matrices)).drop("_n")


def superpose(rows: DataFrame, id_col: str, xyz: str, reference: Sequence[float], masses: Sequence[float] | None = None) -> DataFrame:
    """Each frame moved rigidly onto the reference (least squares, no reflection): id, xyz, rmsd."""
    ref = np.asarray(reference, float).reshape(-1, 3)
    w = np.ones(len(ref)) if masses is None else np.asarray(masses, float)
    w = w / w.sum()
    centre = w @ ref

    def run(batches):
        for f in batches:
            x = np.stack(f.v.to_numpy())[:, : ref.size].reshape(len(f), -1, 3) if len(f) else np.zeros((0, len(ref), 3))
            own = np.einsum("a,nac->nc", w, x)
            moved = x - own[:, None]
            u, _, vt = np.linalg.svd(np.einsum("nai,a,aj->nij", moved, w, ref - centre))
            flip = np.ones((len(f), 3))
            flip[:, 2] = np.sign(np.linalg.det(u @ vt))
            fitted = moved @ ((u * flip[:, None]) @ vt) + centre
            gap = np.sqrt(np.einsum("nac,a->n", (fitted - ref) ** 2, w))
            yield pd.DataFrame({id_col: f[id_col], "xyz": list(fitted.reshape(len(f), -1)), "rmsd": gap})

    return rows.where(F.col(xyz).isNotNull()).select(id_col, F.col(xyz).cast("array<double>").alias("v")).mapInPandas(run, f"{id_col} long, xyz array<double>, rmsd double")


def dihedral(p: Sequence[Column]) -> Column:
    """Signed angle in degrees of four points given by twelve coordinates."""

    def sub(a: list[Column], b: list[Column]) -> list[Column]:
        return [x - y for x, y in zip(a, b, strict=True)]

    def cross(a: list[Column], b: list[Column]) -> list[Column]:
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def dot(a: list[Column], b: list[Column]) -> Column:
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    points = [list(p[i : i + 3]) for i in (0, 3, 6, 9)]
    b1, b2, b3 = (sub(points[i + 1], points[i]) for i in range(3))
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2)))


def grid_sum(points: DataFrame, axes: Sequence[str], weight: str, origin: Sequence[float], spacing: Sequence[float], counts: Sequence[int], soft: float = 1.0) -> DataFrame:
    """Sum over all points of weight / (distance + soft) at each grid point: i, j, k, val.

    The grid is a parameter and bounded; the points stream past it, and only partial grids are shuffled.
    """
    if int(np.prod(counts)) > 4_000_000:
        raise ValueError("cut the grid into parts of at most four million points")
    grid = np.stack(np.meshgrid(*[o + s * np.arange(n) for o, s, n in zip(origin, spacing, counts, strict=True)], indexing="ij"), axis=-1).reshape(-1, 3)

    def run(batches):
        total = np.zeros(len(grid))
        for f in batches:
            x, w = f[["x", "y", "z"]].to_numpy(), f.w.to_numpy()
            step = max(1, 4_000_000 // max(len(grid), 1))
            for k in range(0, len(x), step):
                total += (w[None, k : k + step] / (np.linalg.norm(grid[:, None] - x[None, k : k + step], axis=2) + soft)).sum(axis=1)
        i, j, k = np.unravel_index(np.arange(len(grid)), counts)
        yield pd.DataFrame({"i": i, "j": j, "k": k, "v": total})

    rows = points.na.drop(subset=[*axes, weight]).select(*[F.col(a).cast("double").alias(n) for a, n in zip(axes, "xyz", strict=True)], F.col(weight).cast("double").alias("w"))
    return rows.mapInPandas(run, "i int, j int, k int, v double").groupBy("i", "j", "k").agg(F.sum("v").alias("val"))


def truncate_grid(grid: DataFrame, start: Sequence[int], counts: Sequence[int]) -> DataFrame:
    """The part of a grid from ``start`` with ``counts`` points on each axis, indexed from 0."""
    cond, moved = F.lit(True), {}
    for c, s, n in zip("ijk", start, counts, strict=True):
        cond = cond & F.col(c).between(s, s + n - 1)
        moved[c] = F.col(c) - s
    return grid.where(cond).withColumns(moved)
