"""Incremental ingest: bounded micro-batches, create-only appends, counts that reconcile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; the batch size is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_json(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Newline-delimited JSON; a malformed line fails the batch, so none of it shows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "FAILFAST").json(path)


def ingest_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same in one batch."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Write each row whose key the output lacks, until the source is drained.

    A batch is written under its own number, so a batch that is run again after a
    failure replaces itself and leaves out what earlier batches hold.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            old = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch int").parquet(out).where(F.col("batch") < number)
            new = new.join(old.select(key), key, "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Telemetry of running streams: a line each batch, and how each query ended. Give it to ``spark.streams.addListener``."""

    def __init__(self, emit: Callable[[str], None] = print):
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        self.emit(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit(f"batch {p.batchId} of {p.id}: {p.numInputRows} rows, {p.processedRowsPerSecond or 0.0:.1f} a second, {p.durationMs.get('triggerExecution', 0)} ms")

    def onQueryIdle(self, event) -> None:
        self.emit(f"idle {event.id}")

    def onQueryTerminated(self, event) -> None:
        self.emit(f"ended {event.id}" + (f": {event.exception}" if event.exception else ""))


def visible(spark: SparkSession, out: str) -> int:
    """Rows that readers see."""
    return spark.read.parquet(out).count()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra beyond the blueprint: counts per tumbling window, with a watermark for late rows."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    return timed.withWatermark("__ts", late).groupBy(F.window("__ts", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
