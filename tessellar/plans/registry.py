"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellar.plans import catalog, core_problems, core_problems_sql, queries_tables, queries_vectors  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_problems.QUERIES | catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    problems = core_problems_sql.ORACLES
    return problems | {k: v.replace("{p5}", problems["p5_found"]) for k, v in catalog.ORACLES.items()}
