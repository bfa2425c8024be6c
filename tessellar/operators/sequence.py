"""Sequence tables and the sliding alignment of a sequence to a reference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def best_offset(query: Column, reference: Column) -> Column:
    """struct(matches, start): the start from 0 with most equal letters, of equal ones the first; no left overhang."""
    q, r = letters(query), letters(reference)
    starts = F.sequence(F.lit(0), F.greatest(F.size(r) - 1, F.lit(0)))

    def score(s: Column) -> Column:
        equal = F.zip_with(q, F.slice(r, s + 1, F.size(q)), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        return F.struct((-F.aggregate(equal, F.lit(0), lambda t, x: t + x)).alias("m"), s.alias("s"))

    best = F.array_min(F.transform(starts, score))
    return F.struct((-best["m"]).alias("matches"), best["s"].alias("start"))


def confidence(matches: Column, length: Column) -> Column:
    share = F.try_divide(matches, length)
    return F.when(share >= 0.9, "high").when(share >= 0.7, "medium").otherwise("low")


def join_labels(items: DataFrame, key: str, order: str, letter: str) -> DataFrame:
    """One string a key: the letters in order; null letters are left out."""
    parts = F.array_sort(F.collect_list(F.when(F.col(letter).isNotNull(), F.struct(order, letter))))
    return items.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[letter]), "").alias("sequence"))


def average_linkage_order(rows: Sequence[Sequence[float]]) -> list[int]:
    """Leaf order of an average-linkage tree of at most a few thousand rows, on the driver."""
    x = np.asarray(rows, float)
    if not len(x):
        return []
    if len(x) > 4000:
        raise ValueError("too many rows for a tree on the driver")
    return linkage_leaves(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))


def linkage_leaves(distances: np.ndarray) -> list[int]:
    """As average_linkage_order, from the distances."""
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    groups: dict[int, list[int]] = {i: [i] for i in range(len(d))}
    while len(groups) > 1:
        keys = list(groups)
        sub = d[np.ix_(keys, keys)]
        a, b = sorted(divmod(int(sub.argmin()), len(keys)))
        i, j = keys[a], keys[b]
        n_i, n_j = len(groups[i]), len(groups[j])
        merged = (n_i * d[i] + n_j * d[j]) / (n_i + n_j)
        merged[i] = np.inf
        d[i], d[:, i] = merged, merged
        groups[i] += groups.pop(j)
    return next(iter(groups.values())) if groups else []
