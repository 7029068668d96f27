"""Sharding by proportional stratified interleaving (DataFrame functions only).

Each source's rows are shuffled by a seeded hash and ranked; row r of a source
with n rows gets the fractional rank (2r - 1) / 2n. Sorted by that fraction all
sources interleave in proportion, so a cut into equal runs gives shards that
each match the mixture, with row counts at most one apart.

No window covers a whole source or the whole table: ranks are taken inside hash
ranges (of the shuffle hash, then of the fraction) and the sizes of the ranges
before are added, so a source with a third of all rows spreads over all tasks.

Defined cases: a null source is a source of its own; null text has size 1 and
the checksum of no bytes; rows that repeat are each placed; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.workdir import materialise

N_RANGES = 4096


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds to the rows (by, order, n): rows in the ranges before, and in all ranges."""
    w = Window.partitionBy(*by)
    return counts.select(
        *by, order,
        (F.sum("n").over(w.orderBy(order)) - F.col("n")).alias("before"),
        F.sum("n").over(w).alias("total"),
    )


def interleave(docs: DataFrame, n_shards: int = 16, seed: str = "tidewell-0",
               carry: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Rows (id, carried columns, place, shard, slot).

    ``place`` is the row's position in the interleaved order, ``slot`` that in
    its shard; both gapless from 0. Shards hold floor or ceil of rows / n_shards.
    """
    carry = carry or {}
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("src"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("h"),
        *(c.alias("c_" + k) for k, c in carry.items()),
    ).withColumn("hr", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    # Only id and source are read for the counts: at most 4096 rows a source, combined before the shuffle.
    sizes = _before(slim.groupBy("src", "hr").agg(F.count("*").alias("n")), ["src"], "hr")
    inner = Window.partitionBy("src", "hr").orderBy("h", "id", *("c_" + k for k in carry))
    ranked = (
        slim.join(sizes, ["src", "hr"])
        .withColumn("r", F.row_number().over(inner) + F.col("before"))
        .withColumn("frac", (2 * F.col("r") - 1).cast("double") / (2 * F.col("total")).cast("double"))
        .withColumn("fr", F.floor(F.col("frac") * N_RANGES).cast("int"))
        .select("id", "src", "h", "frac", "fr", *("c_" + k for k in carry))
    )
    ranked = materialise(ranked, "interleave-ranked")
    # 4096 rows at most, whatever the input.
    starts = _before(ranked.groupBy("fr").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)), ["one"], "fr").drop("one")
    w = Window.partitionBy("fr").orderBy("frac", "src", "h", "id", *("c_" + k for k in carry))
    place = (F.row_number().over(w) - 1 + F.col("before")).cast("long")
    s = F.lit(n_shards).cast("long")
    return (
        ranked.join(starts, "fr")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"(place * {n_shards}L) div total").cast("int"))
        .withColumn("slot", F.col("place") - F.floor((F.col("shard") * F.col("total") + s - 1) / s).cast("long"))
        .select(F.col("id").alias(id_col), *(F.col("c_" + k).alias(k) for k in carry), "place", "shard", "slot")
    )
