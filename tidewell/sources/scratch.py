"""Scratch folders of queries that write before they answer.

They stand below ``spark.checkpoint.dir``, which all executors and the driver
can read; a local folder takes its place only where Spark runs in this process.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        _remove(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh path, deleted at the end."""
    path = f"{_root(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        _remove(spark, path)


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to a folder of their own, which is deleted at exit, and read again."""
    spark = rows.sparkSession
    path = f"{_root(spark)}/tidewell/kept-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
