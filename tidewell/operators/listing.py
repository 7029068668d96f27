"""Ordered key listing with prefix, delimiter and keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 1000


def list_page(keys: DataFrame, prefix: str = "", delimiter: str | None = None, max_keys: int = MAX_KEYS, after: str | None = None) -> DataFrame:
    """Rows (entry, is_prefix, key) in byte order: at most ``max_keys`` (0 to 1000).

    Keys that hold the delimiter after the prefix collapse to one entry, the
    part up to and with it. The token of a next page is the last entry of this one,
    so no key is skipped between pages; entries up to the token are left out.
    The prefix is a pushed filter; grouping combines before the shuffle.
    """
    found = keys.where(F.col("key").startswith(prefix)) if prefix else keys
    if after is not None:
        found = found.where(F.col("key") > after)
    if delimiter:
        at = F.expr(f"position({_text(delimiter)}, substring(key, {len(prefix) + 1}))")
        rolled = F.when(at > 0, F.substring(F.col("key"), F.lit(1), F.lit(len(prefix) + len(delimiter) - 1) + at))
        found = found.select("key", rolled.alias("p"))
        entries = found.groupBy(F.coalesce("p", "key").alias("entry"), F.col("p").isNotNull().alias("is_prefix")).agg(F.min(F.when(F.col("p").isNull(), F.col("key"))).alias("key"))
        if after is not None:  # a rolled entry that an earlier page ended with
            entries = entries.where(F.col("entry") > after)
    else:
        entries = found.select(F.col("key").alias("entry"), F.lit(False).alias("is_prefix"), "key").distinct()
    return entries.orderBy("entry").limit(max(0, min(max_keys, MAX_KEYS)))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
