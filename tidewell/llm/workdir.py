"""Written tables in the cluster's shared folder.

Operators that need a cut in their lineage write a Parquet table below
``spark.checkpoint.dir``, which all executors and the driver can read. Where
that setting is absent a local folder takes its place if Spark runs in this one
process (tests, notebooks); on a cluster that is an error.

Tables are deleted at exit. ``scope`` names the run that the tables written
inside it belong to, and deletes those of the same run that were there before;
what other callers hold stays.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The most bytes of an Arrow batch; a single row may be larger.
BATCH_BYTES = 2 << 20
_LOCAL: list[str] = []
#: Paths by the run that wrote them, None outside of any.
_WRITTEN: dict[str | None, list[str]] = {}
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("tidewell_run", default=None)
_KEPT: list[str] = []
_JVM: list = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a local one where that is unset and there is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidewell-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, unique to this call. ``keep``: no scope deletes it."""
    path = f"{shared_root(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    (_KEPT if keep else _WRITTEN.setdefault(_RUN.get(), [])).append(path)
    if not _JVM:
        _JVM.extend((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
        atexit.register(_at_exit)
    return path


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps restart from there."""
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(jvm, conf, paths: list[str]) -> None:
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    """Leave nothing in the shared folder; the JVM may be gone by now."""
    with contextlib.suppress(Exception):
        _delete(*_JVM, [p for own in _WRITTEN.values() for p in own] + _KEPT)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``most``; a smaller limit stays.

    A JVM keeps the buffers of its largest batches, one for each running task,
    so with long texts Spark's own limit (64 MB) fills an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside belong to the run ``name`` of this thread; what it wrote in an earlier scope is deleted.

    So a scope begins when the results of the one before are no longer needed.
    """
    bound_batches(spark)
    run = f"{name}-{threading.get_ident()}"
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _WRITTEN.setdefault(run, []))
    before = _RUN.set(run)
    try:
        yield
    finally:
        _RUN.reset(before)
