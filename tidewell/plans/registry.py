"""All queries of the library proper, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import spatial, storage, tpch, visits

SUITES = (tpch, visits, spatial, storage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for suite in SUITES for name, q in suite.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for suite in SUITES for name, sql in suite.oracle_sql().items()}
