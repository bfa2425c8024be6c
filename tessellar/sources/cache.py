"""Cached JSON records: the latest readable one of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readable(payload: Column) -> Column:
    """Whether the text is complete JSON; false for null."""
    return F.coalesce(F.try_parse_json(payload).isNotNull(), F.lit(False))


def latest_records(cache: DataFrame, key: str, payload: str, when: str, tiebreak: str) -> DataFrame:
    """The readable record fetched last for each key, on equal times that of the largest tiebreak.

    Only the record's number takes part in the choice; payloads are joined afterwards.
    """
    good = cache.where(F.col(key).isNotNull() & readable(F.col(payload)))
    best = good.groupBy(key).agg(F.max(F.struct(when, tiebreak))[tiebreak].alias(tiebreak))
    return cache.join(best.select(tiebreak), tiebreak, "left_semi")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys that have no readable record yet, so that they have to be fetched (again); null keys are no keys."""
    good = cache.where(readable(F.col(payload))).select(key)
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(good, key, "left_anti")
