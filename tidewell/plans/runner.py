"""Timed passes over queries: selection, timeout, results as JSON lines."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def select_numbers(text: str | None, last: int) -> list[int]:
    """``1-3,6`` as [1, 2, 3, 6]; none or ``all`` for every number; raises on anything outside 1 to last."""
    if not text or text == "all":
        return list(range(1, last + 1))
    out: list[int] = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a query number or range: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if not 1 <= low <= high <= last:
            raise ValueError(f"queries are 1 to {last}: {part!r}")
        out += [n for n in range(low, high + 1) if n not in out]
    return out


class QueryTimeout(Exception):
    pass


def run_one(spark: SparkSession, query: Callable[[], DataFrame], timeout: float | None = None) -> tuple[int, float]:
    """(rows, seconds) of one query run to its end; its jobs are cancelled after ``timeout`` seconds."""
    context, tag, late = spark.sparkContext, f"q-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        context.cancelJobsWithTag(tag)  # a session's own tags belong to the thread that added them

    timer = threading.Timer(timeout, stop) if timeout else None
    context.addJobTag(tag)
    began = time.perf_counter()
    try:
        if timer:
            timer.start()
        rows = len(query().collect())
        if late.is_set():  # between two jobs there was nothing to cancel
            raise QueryTimeout(f"more than {timeout} s")
        return rows, time.perf_counter() - began
    except QueryTimeout:
        raise
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"more than {timeout} s") from e
        raise
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)


def run_passes(spark: SparkSession, queries: dict[str, Callable[[SparkSession, str], DataFrame]], sf_dir: str, passes: int = 2, timeout: float | None = None) -> list[dict]:
    """One record per pass: seconds by query, total, and what failed."""
    out = []
    for i in range(passes):
        seconds, failed = {}, {}
        for name, q in queries.items():
            try:
                seconds[name] = round(run_one(spark, lambda: q(spark, sf_dir), timeout)[1], 3)  # noqa: B023
            except Exception as e:  # a failed query is a result, the pass goes on
                failed[name] = f"{type(e).__name__}: {e}"[:300]
        out.append({"pass": i + 1, "total": round(sum(seconds.values()), 3), "queries": seconds, "failed": failed})
    return out


def write_jsonl(records: list[dict], path: str) -> None:
    with open(path, "a") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)
