"""Multi-state series: reorder, index, scatter, backfill and ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.session import materialise


def by_state(energies: DataFrame, states: DataFrame, keys: Sequence[str] = ("sim_no", "sim_iter", "replica")) -> DataFrame:
    """Replica-indexed rows to state-indexed rows: each iteration's permutation inverted by one equi-join."""
    return energies.join(states, list(keys)).drop(keys[-1])


def global_frames(frames: DataFrame, order: Sequence[str], bucket: str, name: str = "frame") -> DataFrame:
    """Adds ``name``, the row's place from 0 over the whole order, without sorting everything into one task.

    ``bucket`` is the leading column of the order; rows are numbered inside each bucket and offset by the counts before
    it, which are one row per bucket: only for few buckets, none of which fills the data (else ``range_index``).
    """
    inside = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    sizes = frames.groupBy(bucket).agg(F.count("*").alias("_n"))
    before = sizes.select(bucket, (F.coalesce(F.sum("_n").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return frames.withColumn("_i", inside).join(before, bucket).withColumn("_i", F.col("_before") + F.col("_i") - 1).drop("_before").withColumnRenamed("_i", name)


def range_index(rows: DataFrame, order: Sequence[str], name: str = "frame", parts: int | None = None) -> DataFrame:
    """As global_frames, where no column is a natural bucket: the rows are split into ranges of the order (as many as the
    session has shuffle partitions), written once to the shared folder with their range's number, numbered inside each
    range and offset by the counts before it, which are one row a range. The order must be unique. A key that fills the
    table is no matter, as ranges are cut by the whole order.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("_k", F.spark_partition_id()), "ranges")
    return global_frames(placed, order, "_k", name).drop("_k")


def skip_leading(frames: DataFrame, iteration: str, skip: int) -> DataFrame:
    """Drops the first ``skip`` iterations and counts the rest from 0; the filter reaches the scan."""
    return frames.where(F.col(iteration) >= skip).withColumn(iteration, F.col(iteration) - skip)


def stride(df: DataFrame, k: int, *index: str) -> DataFrame:
    cond = F.lit(True)
    for c in index:
        cond = cond & (F.pmod(F.col(c), F.lit(k)) == 0)
    return df.where(cond)


def scatter(domain: DataFrame, values: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The whole domain with the values where they are, 0 elsewhere."""
    return domain.join(values, list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def cents(t: Column) -> Column:
    """A temperature at two digits as a whole number, fit for equality."""
    return F.round(t * 100).cast("bigint")


def missing_states(ladder: DataFrame, final: DataFrame) -> DataFrame:
    """(sim_no, state, temperature) of the final ladder's rungs that a simulation's own ladder lacks."""
    rungs = ladder.select("sim_no", cents(F.col("temperature")).alias("c"))
    listed = F.broadcast(final.agg(F.collect_list(F.struct("state", "temperature")).alias("_f")))  # one row: a ladder
    wanted = ladder.select("sim_no").distinct().crossJoin(listed).select("sim_no", F.inline("_f"))
    return wanted.withColumn("c", cents(F.col("temperature"))).join(rungs, ["sim_no", "c"], "left_anti").select("sim_no", "state", "temperature")


def insert_rungs(ladder: DataFrame, rates: DataFrame, threshold: float) -> DataFrame:
    """A rung half way to the lower neighbour wherever the exchange rate with it is below the threshold; states renumbered.

    rates: state, rate (with state - 1). A new rung takes over its lower neighbour's payload, given as ``source_state``.
    """
    w = Window.partitionBy("sim_no").orderBy("state")
    low = F.lag("temperature").over(w)
    with_rate = ladder.withColumn("_low", low).withColumn("_from", F.lag("state").over(w)).join(rates, ["sim_no", "state"], "left")
    new = with_rate.where((F.col("rate") < threshold) & F.col("_low").isNotNull())
    new = new.select("sim_no", ((F.col("_low") + F.col("temperature")) / 2).alias("temperature"), F.col("_from").alias("source_state"))
    both = ladder.select("sim_no", "temperature", F.col("state").alias("source_state")).unionByName(new)
    return both.withColumn("state", F.row_number().over(Window.partitionBy("sim_no").orderBy("temperature", "source_state")) - 1)


def exponential_ladder(i: Column, n: Column, lo: Column, hi: Column) -> Column:
    return lo + (hi - lo) * (F.exp(i / (n - 1)) - 1) / (F.exp(F.lit(1.0)) - 1)


def geometric_ladder(i: Column, n: Column, lo: Column, hi: Column) -> Column:
    return lo * F.pow(hi / lo, i / (n - 1))


def suffix_reset(series: DataFrame, group: Sequence[str], order: str, ok: str) -> DataFrame:
    """A failure makes all earlier flags false; each group's last row, the target, is left out."""
    w = Window.partitionBy(*group).orderBy(order)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    return series.withColumn("_last", last).where("not _last").withColumn("steady", ~F.bool_or(~F.col(ok)).over(rest)).drop("_last")


def deviation_from_last(series: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn("deviation", F.abs(F.col(value) - F.last(value).over(w)))


def prefixes(frames: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Sums of every growing prefix (n, total, mean at each checkpoint) without repeating frames once a checkpoint.

    frames: run, part, value; checkpoints: run, part. Parts are summed once, then cumulated.
    """
    parts = frames.groupBy("run", "part").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    w = Window.partitionBy("run").orderBy("part")
    return checkpoints.join(parts, ["run", "part"], "left").select("run", "part", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum("s").over(w).alias("s")).withColumn("mean", F.col("s") / F.col("n"))


def earlier_checkpoints(points: DataFrame, fraction: float) -> DataFrame:
    """Pairs (current, previous) of a run with ceil-free window ``int(fraction * current) <= previous < current``."""
    a, b = points.alias("a"), points.alias("b")
    first = (F.col("a.point") * fraction).cast("int")
    cond = (F.col("a.run") == F.col("b.run")) & (F.col("b.point") >= first) & (F.col("b.point") < F.col("a.point"))
    return a.join(b, cond).select(F.col("a.run").alias("run"), F.col("a.point").alias("point"), F.col("b.point").alias("previous"), F.col("a.value").alias("value"), F.col("b.value").alias("previous_value"))


def effective_window(equil: Column, cap: float, sim_no: Column) -> tuple[Column, Column]:
    """Share of the run that counts, and the first simulation in it."""
    return F.greatest(1 - equil, F.lit(1 - cap)), ((1 - equil) * sim_no).cast("int")
