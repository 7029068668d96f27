"""The Parquet tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, lazily; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over the tables of ``sf_dir`` (all of them by default)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
