"""State weights of multi-state samples, resampling, and where a series has settled."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.session import materialise


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def state_weights(samples: DataFrame, id_col: str, energies: str, counts: Sequence[int], tolerance: float = 1e-8, most: int = 500) -> tuple[np.ndarray, DataFrame]:
    """Free energies of K states and every sample's weight in each: (f, id + weights array summing to 1 a state).

    samples hold the reduced energies of each sample in all K states. The self-consistent equations are iterated over
    partial log-sums: a pass is one narrow job, and only K numbers a task reach the driver. Energies are written once to
    the shared folder, so no pass recomputes what led to them. Raises if ``most`` passes don't bring the change of every
    free energy under the tolerance.
    """
    kept = materialise(samples.select(F.col(id_col), F.col(energies).cast("array<double>").alias("u")), "energies")
    n_k = np.array(counts, float)
    f = np.zeros(len(n_k))

    def step(f: np.ndarray) -> np.ndarray:
        def run(batches):
            parts = []
            for b in batches:
                if len(b):
                    u = np.stack(b.u.to_numpy())
                    denominator = _log_sum(np.log(n_k) + f - u, 1)
                    parts.append(_log_sum(-u - denominator[:, None], 0))
            if parts:
                yield pd.DataFrame({"x": [_log_sum(np.stack(parts), 0)]})

        got = kept.select("u").mapInPandas(run, "x array<double>").toPandas()
        new = -_log_sum(np.stack(got.x.to_numpy()), 0)
        return new - new[0]

    for _ in range(most):
        new = step(f)
        gap, f = np.abs(new - f).max(), new
        if gap < tolerance:
            break
    else:
        raise RuntimeError(f"free energies still change by {gap:.3g} after {most} passes")

    def weigh(batches):
        for b in batches:
            u = np.stack(b.u.to_numpy()) if len(b) else np.zeros((0, len(f)))
            logs = f - u - _log_sum(np.log(n_k) + f - u, 1)[:, None] if len(b) else u
            yield pd.DataFrame({id_col: b[id_col], "weights": list(np.exp(logs))})

    kind = samples.schema[id_col].dataType.simpleString()
    return f, kept.mapInPandas(weigh, f"{id_col} {kind}, weights array<double>")


def systematic_resample(rows: DataFrame, order: Sequence[str], weight: str, size: int, offset: float = 0.5) -> DataFrame:
    """Adds copies: how often a row is drawn when the cumulative weight is met at ``size`` even steps.

    Every row's share of the draws is right to within one. The rows are cut into ranges of the whole order, so a value
    that fills the table is no matter; cumulative weights are local to a range and offset by the ranges before it, one
    row each. The order must be unique. Weights must not be negative; null weights count as 0.
    """
    w = F.coalesce(F.col(weight), F.lit(0.0))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("_k", F.spark_partition_id()), "ranges")
    local = F.sum(w).over(Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = placed.groupBy("_k").agg(F.sum(w).alias("_t"))
    before = totals.select("_k", (F.sum("_t").over(Window.orderBy("_k")) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    c = placed.withColumn("_c", local).join(F.broadcast(before), "_k")
    high, low = (F.col("_before") + F.col("_c")) / F.col("_all") * size, (F.col("_before") + F.col("_c") - w) / F.col("_all") * size

    def crossed(x: Column) -> Column:
        return F.floor(F.round(x, 6) - offset)

    return c.withColumn("copies", crossed(high) - crossed(low)).drop("_c", "_before", "_all", "_k")


def draw_without_replacement(rows: DataFrame, id_col: str, weight: str, size: int, seed: int = 1) -> DataFrame:
    """``size`` rows, chances by weight, by the smallest -ln(u) / w; u from forty bits of a seeded digest of the id."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 10), 16, 10).cast("bigint")
    u = (bits + 0.5) / (1 << 40)
    return rows.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k", id_col).limit(size).drop("_k")


def backfill(frames: DataFrame, missing: DataFrame, per_state: int, seed: int = 1) -> DataFrame:
    """Frames of other simulations for each missing (sim_no, state): ``per_state`` each, drawn evenly by a seeded digest.

    frames: sim_no, state, frame. Result: sim_no (that lacks them), state, donor, frame.
    """
    donors = frames.select(F.col("sim_no").alias("donor"), "state", "frame")
    chosen = missing.select("sim_no", "state").join(donors, "state").where(F.col("donor") != F.col("sim_no"))
    drawn = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("sim_no", "state", "donor", "frame")], F.lit(str(seed))))
    w = Window.partitionBy("sim_no", "state").orderBy(drawn, "donor", "frame")
    return chosen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_state).drop("_r")


def statistical_inefficiency(x: np.ndarray, least: int = 3) -> float:
    """1 + 2 sum of (1 - t/N) C(t), up to the first C(t) that isn't positive after ``least`` steps."""
    n, d = len(x), x - x.mean()
    variance = (d * d).mean()
    if n < 2 or variance == 0:
        return 1.0
    g = 1.0
    for t in range(1, n - 1):
        c = (d[: n - t] * d[t:]).sum() / ((n - t) * variance)
        if c <= 0 and t > least:
            break
        g += 2 * c * (1 - t / n)
    return max(g, 1.0)


def inefficiencies(x: np.ndarray, least: int = 3) -> np.ndarray:
    """statistical_inefficiency of x[t:] for every start t but the last, up to rounding.

    Each lag is one pass over all starts at once (sums from the end), so the work is length times the most lags that any
    start needs, not length times that for every start.
    """
    n = len(x)
    y = x - x.mean()

    def from_end(v: np.ndarray) -> np.ndarray:
        return np.cumsum(v[::-1])[::-1]

    size = np.arange(n, 0, -1)
    total = from_end(y)
    mean = total / size
    variance = from_end(y * y) / size - mean * mean
    changes = np.flatnonzero(x[1:] != x[:-1])
    flat = np.arange(n) > (changes[-1] if len(changes) else -1)  # x[t:] is one value
    going, g = ~flat & (variance > 0), np.ones(n)
    totals = np.append(total, 0.0)
    for lag in range(1, n - 1):
        m = n - lag - 1  # starts with at least two pairs of this lag
        live = going[:m]
        if not live.any():
            break
        pairs = from_end(y[: n - lag] * y[lag:])[:m]
        first, last = totals[:m] - totals[n - lag], totals[lag : lag + m]
        c = (pairs - mean[:m] * (first + last) + (size[:m] - lag) * mean[:m] ** 2) / ((size[:m] - lag) * np.where(live, variance[:m], 1.0))
        if lag > least:
            live = live & (c > 0)
            going[:m] = live
        g[:m] += np.where(live, 2 * c * (1 - lag / size[:m]), 0.0)
    return np.maximum(g, 1.0)[: max(n - 1, 1)]


def settled(x: np.ndarray, step: int = 1) -> tuple[int, float, float]:
    """Start of the part with the most independent samples, its inefficiency, and their number.

    All starts are weighed together; those within rounding of the best are measured one by one, the first best is taken.
    """
    best = (0, 1.0, 1.0)
    if not len(x):
        return best
    gained = (len(x) + 1 - np.arange(max(len(x) - 1, 1))) / inefficiencies(x)
    tried = np.arange(0, len(gained), step)
    for t in tried[gained[tried] >= gained[tried].max() * (1 - 1e-6)].tolist():
        part = x[t:]
        g = statistical_inefficiency(part)
        if (len(part) + 1) / g > best[2]:
            best = (t, g, (len(part) + 1) / g)
    return best


def equilibration(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """t0, g and n_independent of every series; every start is tried. Null and NaN are skipped.

    One series is one group, so it must fit a task; the work is its length times the lags until the correlation is gone.
    """
    schema = series.select(*keys).schema

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        t, g, n = settled(f[value].to_numpy(float))
        return pd.DataFrame([[*(f[k].iloc[0] for k in keys), t, g, n]], columns=[*keys, "t0", "g", "n_independent"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    rows = series.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, order, value)
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, t0 int, g double, n_independent double")
