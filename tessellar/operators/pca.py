"""Principal components by partial sums of products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FEATURES = 4096


@dataclass
class Components:
    mean: np.ndarray
    vectors: np.ndarray  # one row a component
    ratios: np.ndarray

    def first(self, n: int) -> Components:
        return Components(self.mean, self.vectors[:n], self.ratios[:n])


def fit(rows: DataFrame, vector: str, threshold: float | None = None, compat: bool = False) -> Components:
    """Components by explained variance; signs fixed so that each one's largest loading is positive.

    Every task sums its vectors and their products; the rows of these sums are added as arrays, so d + 2 rows of d values
    cross the network for each task, and as many reach the driver, whose size is checked.
    With a threshold the components are kept up to the first that reaches it; ``compat`` drops that one, as older
    results do.
    """
    data = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    first = data.select(F.size("v").alias("d")).first()
    if first is None:
        raise ValueError("no vectors")
    d = first["d"]
    if d > MAX_FEATURES:
        raise ValueError(f"{d} features; at most {MAX_FEATURES}")

    def sums(batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for f in batches:
            if len(f):
                x = np.stack(f.v.to_numpy())
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pd.DataFrame({"row": range(d + 2), "x": [*p, s, np.full(d, float(n))]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": f.row[:1], "x": [np.stack(f.x.to_numpy()).sum(0)]})

    total = data.mapInPandas(sums, "row int, x array<double>").groupBy("row").applyInPandas(add, "row int, x array<double>").toPandas()
    out = np.stack(total.sort_values("row").x.to_numpy())
    n, mean = out[d + 1, 0], out[d] / out[d + 1, 0]
    values, vectors = np.linalg.eigh((out[:d] - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order].T
    vectors *= np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)])[:, None]
    ratios = np.maximum(values[order], 0) / max(values.sum(), 1e-300)
    keep = d if threshold is None else kept(ratios, threshold, compat)
    return Components(mean, vectors[:keep], ratios[:keep])


def kept(ratios: np.ndarray, threshold: float, compat: bool = False) -> int:
    """Components up to the first whose cumulative ratio reaches the threshold; all if none does."""
    reached = np.flatnonzero(np.cumsum(ratios) >= threshold - 1e-12)
    if not len(reached):
        return len(ratios)
    return int(reached[0]) if compat else int(reached[0]) + 1


def transform(rows: DataFrame, id_col: str, vector: str, model: Components) -> DataFrame:
    """id, scores. Missing entries take the model's mean, so they add nothing."""

    def run(batches):
        for f in batches:
            x = np.array([[np.nan if e is None else e for e in v] for v in f.v], float).reshape(len(f), len(model.mean))
            yield pd.DataFrame({id_col: f[id_col], "scores": list(np.where(np.isnan(x), 0, x - model.mean) @ model.vectors.T)})

    return rows.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"{id_col} long, scores array<double>")


def loading_shares(model: Components, component: int, group_size: int) -> list[tuple[int, float]]:
    """Share of a component's squared loading held by each run of ``group_size`` features."""
    square = model.vectors[component] ** 2
    return [(g, float(square[g * group_size : (g + 1) * group_size].sum() / square.sum())) for g in range(-(-len(square) // group_size))]


def save(spark, model: Components, path: str) -> None:
    rows = [("mean", -1, 0.0, model.mean.tolist()), *(("component", k, float(r), v.tolist()) for k, (v, r) in enumerate(zip(model.vectors, model.ratios, strict=True)))]
    spark.createDataFrame(rows, "part string, pc int, ratio double, x array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Components:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["pc"])
    return Components(np.array(rows[0]["x"]), np.array([r["x"] for r in rows[1:]]), np.array([r["ratio"] for r in rows[1:]]))
