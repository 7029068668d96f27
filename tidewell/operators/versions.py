"""State from version logs: latest-wins, conditional writes, upload completion, bounded expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str], op: str = "op", delete: str = "delete") -> DataFrame:
    """The newest row of each key, without keys whose newest row is a delete.

    ``max_by`` over a struct combines before the shuffle, so a key with very many
    versions is no hot spot.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*keys, "r.*").where(F.col(op) != delete)


def conditional_puts(requests: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``status`` to rows (key, condition, want): 200, or 412 where the condition fails.

    ``absent``: the key must not exist; ``match``: its etag must equal ``want``; null: no condition.
    """
    have = current.select(F.col(key), F.col("etag").alias("have"))
    fails = F.when(F.col("condition") == "absent", F.col("have").isNotNull()).when(F.col("condition") == "match", ~F.coalesce(F.col("have") == F.col("want"), F.lit(False))).otherwise(False)
    return requests.join(have, key, "left").withColumn("status", F.when(fails, 412).otherwise(200)).drop("have")


def complete_check(recorded: DataFrame, listed: DataFrame, upload: list[str], part: str, tag: str) -> DataFrame:
    """Rows (upload, ok): whether listed and recorded parts are the same set with the same tags."""
    both = recorded.withColumnRenamed(tag, "recorded_tag").join(listed.withColumnRenamed(tag, "listed_tag"), [*upload, part], "full")
    return both.groupBy(*upload).agg(F.bool_and(F.coalesce(F.col("recorded_tag") == F.col("listed_tag"), F.lit(False))).alias("ok"))


def expiry_takes(expired: DataFrame, order: list[Column], weight: str, rows: int = 4096, visits: int = 64) -> DataFrame:
    """The first uploads in ``order``, ``visits`` at most, with ``take``: how much of each goes in this run.

    ``rows`` is spent in order, inside the upload where it ends; with what is left
    as its weight, the next run goes on there. The limit comes first, so the
    running sum sees ``visits`` rows.
    """
    if not 1 <= rows <= 8192:
        raise ValueError("the row budget must be 1 to 8192")
    first = expired.orderBy(*order).limit(visits)
    left = F.lit(rows) - F.col("used") + F.col(weight)
    return (
        first.withColumn("used", F.sum(weight).over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        .where((F.col("used") <= rows) | (left > 0)).withColumn("take", F.least(F.col(weight), left).cast("long")).drop("used")
    )


def expiry_budget(expired: DataFrame, order: list[Column], weight: str, rows: int = 4096, visits: int = 64) -> DataFrame:
    """Of ``expiry_takes``, the uploads that go to their end; one that the budget ends in needs further runs."""
    return expiry_takes(expired, order, weight, rows, visits).where(F.col("take") == F.col(weight)).drop("take")
