"""The N best items of every group, by partition lower bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(items: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n items of highest score in every group, with pos from 1; equal scores in plain string order of the item.

    1. Each partition ranks its own items of a group and keeps n: its n-th best (score, item) is a lower bound for the
       group's n-th best, whatever the other partitions hold.
    2. The maximum bound of each group is joined to what the partitions kept, and what lies below it is dropped.
    3. The survivors, hardly more than n a group, are ranked.
    The order is total, so a tie at the bound can't let many through. A group that fills the data is spread over all
    partitions and none of them sends more than n of its items. A group of which no partition holds n items has no bound
    and keeps all: what is ranked of it is under n rows a partition, and the last ranking keeps n a task before it
    shuffles. Null groups and items are left out; null and NaN scores are no scores. Repeated items count as often as they
    are given. Extra columns are dropped; column names may be anything.

    Both sides of the join read one exchange of the local ranks: nothing but the score is filtered, and the keys are
    compared null-safely, as a filter on a key would be pushed into one side only, below whatever the key is worked out by.
    """
    score_of = F.col(score).cast("double")
    sound = F.col(group).isNotNull() & F.col(item).isNotNull() & ~F.isnan(score_of)
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.when(sound, score_of).alias("s"), F.spark_partition_id().alias("part")).where("s is not null")
    order = [F.col("s").desc(), F.col("i").asc()]
    local = rows.withColumn("r", F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))).where(F.col("r") <= n)
    last = F.when(F.col("r") == n, F.struct((-F.col("s")).alias("s"), F.col("i").alias("i")))
    bound = local.groupBy(F.col("g").alias("bg")).agg(F.min(last).alias("bound")).where("bound is not null")
    key: Column = F.struct((-F.col("s")).alias("s"), F.col("i").alias("i"))
    kept = local.join(bound, F.col("g").eqNullSafe(F.col("bg")), "left").where(F.col("bound").isNull() | (key <= F.col("bound")))
    ranked = kept.select("g", "i", "s", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("pos")).where(F.col("pos") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "pos")
