"""Summaries, histograms and comparisons of distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def acceptance_rate(counts: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean of accepted / proposed; 0 where any share is undefined."""
    rate = F.when(F.bool_or(F.col("proposed") == 0), 0.0).otherwise(F.avg(F.try_divide("accepted", "proposed")))
    return counts.groupBy(*keys).agg(F.round(rate, digits).alias("rate"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin from 0; the last bin holds its right end."""
    return F.least(F.floor((x - lo) * n / (hi - lo)), F.lit(n - 1))


def histogram(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """Counts and densities over bins on the range of all values: keys, bin, n, density."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", bin_of(F.col(value), F.col("_lo"), F.col("_hi"), n))
    counts = rows.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    joined = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.select(*keys, "bin", "n", (F.col("n") / (F.col("_t") * (F.col("_hi") - F.col("_lo")) / n)).alias("density"))


def jensen_shannon(p: DataFrame, q: DataFrame, key: Sequence[str], n: int, floor: float = 1e-10) -> DataFrame:
    """Jensen-Shannon distance, base 2, of two histograms (bin, density) of each key, with a floor under each density."""
    bins = p.select(*key).unionByName(q.select(*key)).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bin", F.col("bin").cast("bigint"))
    both = bins.join(p.select(*key, "bin", F.col("density").alias("p")), [*key, "bin"], "left").join(q.select(*key, "bin", F.col("density").alias("q")), [*key, "bin"], "left")
    both = both.select(*key, *[(F.coalesce(c, F.lit(0.0)) + floor).alias(c) for c in ("p", "q")])
    sums = both.groupBy(*key).agg(F.sum("p").alias("_sp"), F.sum("q").alias("_sq"))
    x = both.join(sums, list(key)).withColumns({"p": F.col("p") / F.col("_sp"), "q": F.col("q") / F.col("_sq")})
    m = (F.col("p") + F.col("q")) / 2
    term = F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m)
    return x.groupBy(*key).agg(F.sqrt(F.greatest(F.sum(term) / 2, F.lit(0.0))).alias("jsd"))


def frobenius(pairs: DataFrame, n: int, a: str = "a", b: str = "b", i: str = "i", j: str = "j") -> DataFrame:
    """Frobenius norm of the difference of two symmetric n x n matrices over n (n - 1) / 2, so that it shrinks with n.

    The matrices are given by their cells i <= j; cells off the diagonal count for both halves.
    """
    gap = F.col(a) - F.col(b)
    times = F.when(F.col(i) == F.col(j), 1).otherwise(2)
    return pairs.agg((F.sqrt(F.sum(times * gap * gap)) / (n * (n - 1) / 2)).alias("norm"))


def kernel_density(points: DataFrame, x: str, y: str, steps: int = 100) -> DataFrame:
    """Gaussian density of points on a steps x steps grid, Scott's bandwidth, full covariance.

    The grid is the small side (steps squared rows, a parameter): each task adds its points to the whole grid in numpy, and
    only the grids are shuffled. Points are taken by cells about a bandwidth wide: relative to a cell's centre the
    exponent is a part of the grid alone, and a product of a part of x and a part of y for each point, so a cell is one
    matrix product; the points' offsets are small, so nothing overflows.
    """
    import numpy as np
    import pandas as pd

    s = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = s.agg(F.count("*").alias("n"), F.covar_samp("x", "x").alias("xx"), F.covar_samp("x", "y").alias("xy"), F.covar_samp("y", "y").alias("yy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not m["n"] or m["n"] < 3:
        return points.sparkSession.createDataFrame([], "i int, j int, density double")
    cov = np.array([[m["xx"], m["xy"]], [m["xy"], m["yy"]]]) * m["n"] ** (-2 / 6)
    inverse, scale = np.linalg.inv(cov), 1 / (m["n"] * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    gx, gy = np.linspace(m["x0"], m["x1"], steps), np.linspace(m["y0"], m["y1"], steps)

    a, b, c = inverse[0, 0], inverse[0, 1], inverse[1, 1]
    wide_x, wide_y = np.sqrt(cov[0, 0]), np.sqrt(cov[1, 1])

    def onto(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        kx, ky = np.floor((x - m["x0"]) / wide_x).astype(np.int64), np.floor((y - m["y0"]) / wide_y).astype(np.int64)
        order = np.lexsort((ky, kx))
        x, y, kx, ky = x[order], y[order], kx[order], ky[order]
        cuts = np.flatnonzero(np.diff(kx, prepend=-1) | np.diff(ky, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)], strict=True):
            cx, cy = m["x0"] + (kx[i] + 0.5) * wide_x, m["y0"] + (ky[i] + 0.5) * wide_y
            px, py, ux, uy = x[i:j] - cx, y[i:j] - cy, gx - cx, gy - cy
            own = np.exp(-(a * px * px + 2 * b * px * py + c * py * py) / 2)
            there = np.exp(-(a * ux[:, None] ** 2 + 2 * b * ux[:, None] * uy[None] + c * uy[None] ** 2) / 2)
            total += there * ((np.exp(np.outer(ux, a * px + b * py)) * own) @ np.exp(np.outer(b * px + c * py, uy)))

    def add(batches):
        total, held, size = np.zeros((steps, steps)), [], 0
        for f in batches:
            held.append(f)
            size += len(f)
            if size > 1_000_000:
                onto(total, np.concatenate([h.x for h in held]), np.concatenate([h.y for h in held]))
                held, size = [], 0
        if size:
            onto(total, np.concatenate([h.x for h in held]), np.concatenate([h.y for h in held]))
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return s.mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") * scale).alias("density"))
