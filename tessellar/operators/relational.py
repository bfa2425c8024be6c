"""Filters, groups, ranks and reports over any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failing_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds (a rule that is null doesn't); null if none does."""
    return F.coalesce(*[F.when(fails, F.lit(name)) for name, fails in rules])


def classify(text: Column, keywords: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Class of the first keyword that the lower-cased text contains, in the order given."""
    found = F.lower(text)
    out = F.coalesce(*[F.when(found.contains(word), F.lit(name)) for word, name in keywords])
    return F.coalesce(out, F.lit(default)) if default is not None else out


def value_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def relative_frequency(df: DataFrame, keys: Sequence[str], unit: str, digits: int | None = None) -> DataFrame:
    """Rows of each key over the number of distinct units in the whole table: n, frequency."""
    total = df.agg(F.countDistinct(unit).alias("total"))
    f = F.col("n") / F.col("total")
    return value_counts(df, keys).crossJoin(F.broadcast(total)).select(*keys, "n", (F.round(f, digits) if digits is not None else f).alias("frequency"))


def band(df: DataFrame, token: str, unit: str, lo_percent: int, hi_percent: int, unique: bool = False) -> DataFrame:
    """Tokens held by at least max(1, ceil(lo %)) and at most floor(hi %) of the distinct units, with the count.

    ``unique`` says that no (token, unit) is null or repeated, so that rows can be counted instead of distinct units, and
    both the counts and the total read one exchange of the rows.
    """
    total = df.agg(F.countDistinct(unit).alias("total"))
    named = df if unique else df.where(F.col(token).isNotNull() & F.col(unit).isNotNull())
    counted = named.groupBy(token).agg((F.count("*") if unique else F.countDistinct(unit)).alias("n"))
    low = F.greatest(F.lit(1), F.floor((F.col("total") * lo_percent + 99) / 100))
    return counted.crossJoin(F.broadcast(total)).where((F.col("n") >= low) & (F.col("n") <= F.floor(F.col("total") * hi_percent / 100))).select(token, "n")


def keep_members(df: DataFrame, chosen: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(chosen.select(on).distinct() if isinstance(on, str) else chosen.select(*on).distinct(), on, "left_semi")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The report's first k rows; the order must end in a unique column."""
    return df.orderBy(*order).limit(k)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; combined before the shuffle by the engine's group limit."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def modal_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the smallest, as a one-row frame."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).select(column)


def keep_modal(df: DataFrame, column: str) -> DataFrame:
    return df.join(F.broadcast(modal_value(df, column)), column, "left_semi")


def divide(df: DataFrame, entity: str, item: str, required: DataFrame) -> DataFrame:
    """Entities that hold every required item. Duplicates count once; with nothing required every entity qualifies."""
    need = required.select(item).distinct()
    total = need.agg(F.count("*").alias("need"))
    held = df.join(need.withColumn("_need", F.lit(1)), item, "left").groupBy(entity).agg(F.countDistinct(F.when(F.col("_need") == 1, F.col(item))).alias("held"))
    return held.crossJoin(F.broadcast(total)).where("held = need").select(entity)


def bounded_by_max(df: DataFrame, column: str, share: float) -> DataFrame:
    """Rows whose value is at least ``share`` of the column's maximum."""
    top = df.agg(F.max(column).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(F.col(column) >= share * F.col("_top")).drop("_top")


def natural_key(label: Column) -> tuple[Column, Column]:
    """Sort keys of labels like 10.2: both parts as ints; a label of another form sorts last."""
    bad = ~label.rlike(r"^\d+\.\d+$") | label.isNull()
    return tuple(F.when(bad, 999).otherwise(F.try_element_at(F.split(label, r"\."), F.lit(i)).try_cast("int")) for i in (1, 2))


def wide_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str], how: str = "sum", fill: float | None = None) -> DataFrame:
    """One column per stated value. The columns are given, so nothing is collected to find them."""
    out = df.groupBy(row).pivot(column, list(columns)).agg(getattr(F, how)(value))
    return out.na.fill(fill, list(columns)) if fill is not None else out


def nonnull_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def islands(df: DataFrame, group: Sequence[str], number: str, least: int = 1) -> DataFrame:
    """Runs of consecutive numbers in each group: start, stop, length, of at least ``least``. Repeats count once."""
    distinct = df.where(F.col(number).isNotNull()).select(*group, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*group).orderBy(number))
    out = distinct.withColumn("_i", island).groupBy(*group, "_i").agg(F.min(number).alias("start"), F.max(number).alias("stop"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_i")


def population_summary(df: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), digits).alias("mean"), F.round(F.stddev_pop(v), digits).alias("std"))


def all_pass(passed: Column) -> Column:
    """True for a non-empty set in which every value is true."""
    return (F.count("*") > 0) & F.coalesce(F.bool_and(passed), F.lit(False))
