"""Table lifecycle: Parquet in, typed tables and views out, over a path root that may be local or an object store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_glob(spark: SparkSession, path: str, pattern: str | None = None, binary_as_string: bool = False) -> DataFrame:
    """Parquet files below a path whose names match a pattern."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(path)
    if not binary_as_string:
        return df
    return df.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in df.schema))


def retype_hits(df: DataFrame) -> DataFrame:
    """Days to DATE and seconds to TIMESTAMP for the date and time columns that the frame has."""
    days = {c: F.date_from_unix_date(F.col(c).cast("int")) for c in ("EventDate",) if c in df.columns}
    seconds = {c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz") for c in ("EventTime", "ClientEventTime", "LocalEventTime") if c in df.columns}
    return df.withColumns(days | seconds) if days or seconds else df


@dataclass
class Lake:
    """Tables below ``root``: ``s3a://...``, ``file://...``, or none for cached tables in memory."""

    spark: SparkSession
    root: str | None = None

    def load(self, name: str, df: DataFrame, views_only: bool = False) -> int:
        """Replace the table, show it as a view of that name, and return its row count as read back."""
        if self.root is None:
            table = df.cache()
        else:
            if not views_only:
                df.write.mode("overwrite").parquet(f"{self.root.rstrip('/')}/{name}")
            table = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}")
        table.createOrReplaceTempView(name)
        return table.count()

    def view(self, name: str) -> DataFrame:
        """The view of a table that an earlier load wrote."""
        table = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}") if self.root else self.spark.table(name)
        table.createOrReplaceTempView(name)
        return table
