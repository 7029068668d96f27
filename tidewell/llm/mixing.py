"""Mixing sources to target weights.

Sizes are summed per source, targets are filled by weight up to a cap per
source, and the repetition rate of a source is target / size. Each document is
emitted floor(rate) times plus one copy more when its seeded hash, read as a
uniform number, is below the fraction: expectation exactly the target, and the
same choice on every run and retry, with no state between rows.

Targets ("water filling"): with sources in ascending order of cap / weight, the
first j sources are capped where their cap is not above the common level; the
level is (budget - capped) / (weights left). That closed form equals resharing
the excess by weight until no source is above its cap.

Defined cases: a null source is a source of its own, last in order; null or
empty text has size 0; a source of size 0 has target 0 and rate 0, so its
documents are not taken; rows that repeat are decided alike; an empty table
gives no rows; other columns of the input pass through ``take`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textkit import free_name

WORD = "[^ \\\\t-\\\\r]+"


def n_words(text: str = "text") -> Column:
    """Words of a text: maximal runs of anything but space and U+0009-U+000D."""
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From rows (source, source_size): rows (source, source_size, target, rate).

    One row per source, so its windows see as many rows as there are sources.
    """
    by_name = Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    i = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (i % len(weights) + 1).cast("int"))
    w = sizes.withColumn("one", F.lit(1)).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    filling = Window.partitionBy("one").orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("one")
    budget = F.sum("source_size").over(everything) * share
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / left
    w = w.withColumn("own", F.when(F.col("most") <= level * F.col("weight"), None).otherwise(level))
    # The level of the first source that is not capped holds for all after it.
    first = F.min(F.when(F.col("own").isNotNull(), F.struct((F.col("most") / F.col("weight")).alias("k"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("own").alias("level")))).over(everything)
    target = F.when(F.col("own").isNull(), F.col("most")).otherwise(first["level"] * F.col("weight"))
    return (
        w.withColumn("target", target)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of a seeded MD5."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def take(docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
         seed: str = "mix-0", id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct (size, source_size, target, rate, copies), and that column's name, which no other has.

    The rates are joined by source with no broadcast hint: Spark broadcasts
    them after measuring, and otherwise splits a hot source's partition.
    """
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    name, own_key, own_rate, own_size = (free_name(docs, f"mix{c}") for c in ("", "_key", "_rate", "_size"))
    r = rates(sizes, weights, share, cap).select(key(F.col("source")).alias(own_key), F.struct("source_size", "target", "rate").alias(own_rate))
    rate = F.col(own_rate)["rate"]
    copies = (F.floor(rate) + F.when(uniform(id_col, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    mix = F.struct(F.col(own_size).alias("size"), F.col(own_rate)["source_size"].alias("source_size"), F.col(own_rate)["target"].alias("target"), rate.alias("rate"), copies.alias("copies"))
    return (
        docs.withColumn(own_size, size)
        .withColumn(own_key, key(F.col(source_col)))
        .join(r, own_key)
        .withColumn(name, mix)
        .drop(own_key, own_rate, own_size)
    ), name


def mix(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, in the input's columns."""
    taken, name = take(docs, n_words() if size is None else size, **options)
    copies = F.col(name)["copies"]
    return taken.where(copies > 0).withColumn(free_name(taken, "copy"), F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
