"""Line dedup (DataFrame functions only).

Keys are hashed to 128 bits and range-partitioned with a secondary sort by
document and position; a running first_value streams through each key's rows,
so the first document is known without holding the group. What comes back is a
compressed bitmap per document, never text.

A key may be on a third of all lines, so keys are dealt twice. First by (hash,
1 of 64 document groups): all but the lines of the group's first document drop
at once, whatever the other groups hold. Then the survivors by hash: at most 64
documents a key are left, of which the first keeps its lines.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.
Keys of at least ``least`` code points that occur in two documents or more
lose their lines everywhere but in the smallest id (within it, repeats stay).

Defined cases: null or empty text is one empty line; a null id counts as one
document after all others; rows repeated with the same id and text get the same
result; an empty table gives no rows; other columns pass through ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textkit import free_name
from tidewell.llm.workdir import materialise

_LAST = (1 << 63) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    trimmed = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is the faster of the two and the same on ASCII.
    return F.when(F.octet_length(trimmed) == F.length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ld_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("ld_text")]


def keep_bitmaps(docs: DataFrame, least: int = 10, groups: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (ld_id, ld_text, keep) for documents that lose lines.

    ``keep``: array of (word, bits), ascending; bit b of word w says whether
    line 64 w + b stays. Words in which all lines stay are left out.
    """
    lines = docs.select(*_identified(docs, id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least)
    hashed = lines.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"), F.pmod(F.xxhash64("ld_id"), F.lit(groups)).cast("byte").alias("group"), "ld_id", "ld_text", "pos")
    order = ["ld_id", "pos"]
    first = F.first("ld_id").over(Window.partitionBy("h", "g", "group").orderBy(*order))
    grouped = materialise(hashed.repartitionByRange("h", "group").withColumn("gone", F.col("ld_id") > first), "lines-grouped")
    first = F.first("ld_id").over(Window.partitionBy("h", "g").orderBy(*order))
    rest = grouped.where("not gone").repartitionByRange("h").withColumn("gone", F.col("ld_id") > first)
    gone = grouped.where("gone").unionByName(rest.where("gone"))
    word = (
        gone.groupBy("ld_id", "ld_text", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("lost"))
    )
    return word.groupBy("ld_id", "ld_text").agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"))


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct (text: kept lines joined by a newline, n_lines, n_dropped), and that column's name, which no other has."""
    name, row = free_name(docs, "deduped"), free_name(docs, "ld_row")
    # The rows as they came are one struct from here, so their names can't meet those of this join.
    found = _apply(docs.select(F.struct(*docs.columns).alias(row), *_identified(docs, id_col, text_col)), bitmaps, f"{row}.`{text_col}`")
    return found.select(*(F.col(row)[c].alias(c) for c in docs.columns), F.col("ld_result").alias(name)), name


def _apply(docs: DataFrame, bitmaps: DataFrame, text_col: str) -> DataFrame:
    lines = lines_of(F.col(text_col))
    dropped = F.aggregate(F.col("ld_keep"), F.lit(0).cast("long"), lambda n, w: n + F.bit_count(F.bitwise_not(w["bits"])))
    # Dense words up to the last one that drops a line, so each line finds its bit by index.
    dense = F.expr("aggregate(ld_keep, cast(array() as array<bigint>), (a, w) -> concat(a, array_repeat(-1L, w.word - size(a)), array(w.bits)))")
    text = F.when(F.col("ld_keep").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.expr(f"filter(split(coalesce({text_col}, ''), '\\n', -1), (x, i) -> coalesce(getbit(get(ld_bits, i div 64), i % 64), 1) = 1)"), "\n"))
    return (
        docs.join(bitmaps.withColumnRenamed("keep", "ld_keep"), ["ld_id", "ld_text"], "left")
        .withColumn("ld_bits", F.when(F.col("ld_keep").isNotNull(), dense))
        .withColumn("ld_result", F.struct(text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped")))
    )


def dedup(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with the result struct beside its columns, and the struct's name."""
    names = {k: options[k] for k in ("id_col", "text_col") if k in options}
    return apply(docs, keep_bitmaps(docs, **options), **names)
