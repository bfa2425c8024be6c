"""Saved matrices and models: where they go, and which copy is read."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_available(first: DataFrame, second: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Values of the first table, those of the second where it has none."""
    a, b = first.withColumnRenamed(value, "_a"), second.withColumnRenamed(value, "_b")
    return a.join(b, list(on), "full").select(*on, F.coalesce("_a", "_b").alias(value))


def write_root(source: str, cache: str | None, read_only: bool) -> str | None:
    """None in read-only mode, else the cache folder if there is one, else the source's own."""
    return None if read_only else cache or source


def save(df: DataFrame, name: str, source: str, cache: str | None = None, read_only: bool = False) -> str | None:
    root = write_root(source, cache, read_only)
    if root is None:
        return None
    path = os.path.join(root, name)
    df.write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, name: str, source: str, cache: str | None = None) -> DataFrame | None:
    """The cached copy, else the source's, else None."""
    for root in filter(None, (cache, source)):
        try:
            return spark.read.parquet(os.path.join(root, name))
        except AnalysisException:
            continue
    return None


def compute_or_load(spark: SparkSession, name: str, compute: Callable[[], DataFrame], source: str, cache: str | None = None, read_only: bool = False) -> DataFrame:
    """What is stored, else what is computed, stored once and read back; computed anew, unstored, in read-only mode."""
    found = load(spark, name, source, cache)
    if found is not None:
        return found
    made = compute()
    return made if save(made, name, source, cache, read_only) is None else load(spark, name, source, cache)


class Cache:
    """Computed tables by name: in the process first, then in the folder, else computed once and kept in both.

    What is held in the process is a plan that reads the folder's files, so it costs no memory; ``forget`` drops it, as a
    new process would have none.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.held: dict[str, DataFrame] = {}
        self.made: list[str] = []

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.held:

            def counted() -> DataFrame:
                self.made.append(name)
                return make()

            self.held[name] = compute_or_load(self.spark, name, counted, self.root)
        return self.held[name]

    def forget(self) -> None:
        self.held.clear()
