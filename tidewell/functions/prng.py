"""A counter-based 64-bit generator for filler data, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def sequence(seed: int, n: int, start: int = 0) -> np.ndarray:
    """Values start .. start + n - 1 of the splitmix64 sequence of a seed."""
    z = np.arange(start + 1, start + n + 1, dtype=np.uint64) * _GAMMA + np.uint64(seed & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def nth(seed: int, i: Column) -> Column:
    """The i-th value of a seed's sequence, as a decimal string (unsigned 64 bits fit no integer type)."""

    def run(batch: pa.Array) -> pa.Array:
        z = (np.asarray(batch.to_numpy(zero_copy_only=False), np.int64).astype(np.uint64) + np.uint64(1)) * _GAMMA + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return pa.array((z ^ (z >> np.uint64(31))).astype(str), pa.string())

    return F.arrow_udf(run, T.StringType())(i)


def filler(seed: int, size: int) -> bytes:
    """Deterministic bytes."""
    return sequence(seed, -(-size // 8)).astype("<u8").tobytes()[:size]


def filler_objects(spark: SparkSession, n: int, size: int, seed: int = 0x5EED0000) -> DataFrame:
    """Rows (key, data): n objects of ``size`` bytes, object i from seed + i, made on the executors."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.record_batch({"key": pa.array([f"obj-{i:05d}.bin" for i in ids]), "data": pa.array([filler(seed + i, size) for i in ids], pa.binary())})

    return spark.range(n).mapInArrow(run, "key string, data binary")
