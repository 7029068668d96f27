"""Queries as SQL text that Spark and DuckDB both take.

A text may hold ``[[spark|duck]]`` where the dialects differ. ``prelude`` is a
list of common table expressions put before the text, for derived tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.tables import TABLES, table

_CHOICE = re.compile(r"\[\[(.*?)\|(.*?)\]\]", re.S)


def dialect(sql: str, spark: bool) -> str:
    """The text for one engine."""
    return _CHOICE.sub(lambda m: m[1 if spark else 2], sql)


def with_prelude(sql: str, prelude: str) -> str:
    """``prelude`` (name AS (...), ...) before a query that may have its own WITH."""
    if not prelude:
        return sql
    body = sql.lstrip()
    return f"WITH {prelude}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {prelude} {body}"


def spark_query(sql: str, prelude: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """A callable (spark, sf_dir) that binds the tables a text names and plans it with Catalyst."""
    full = dialect(with_prelude(sql, prelude), True)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", full)]
    marked = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", full) if used else full

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(marked, **{t: table(spark, sf_dir, t) for t in used})

    return run


def suite(queries: dict[str, str], prelude: str = "") -> tuple[dict[str, Callable], dict[str, str]]:
    """Spark callables and DuckDB texts of a dict of queries."""
    return {k: spark_query(q, prelude) for k, q in queries.items()}, {k: dialect(with_prelude(q, prelude), False) for k, q in queries.items()}
