"""Fixed-size chunks of byte objects: framing, range arithmetic, planning and reassembly, as column expressions.

Chunk rows hold ``CHUNK`` bytes, the last row of an object what is left; an
empty object has no rows. Ranges are inclusive. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 8120
#: Chunk tables are laid out in this many folders by file id, so a read of one file prunes the rest.
FOLDERS = 32


def folder_of(file_id: Column) -> Column:
    """The layout folder of a file id; a read must filter by it, as no planner can infer it."""
    return F.pmod(F.xxhash64(file_id), F.lit(FOLDERS)).cast("int")


def chunk_rows(objects: DataFrame, data: str = "data", size: int = CHUNK) -> DataFrame:
    """One row (no, chunk) per chunk in place of the ``data`` column."""
    rest = [c for c in objects.columns if c != data]
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    # sequence(0, -1) would count down, so empty objects are filtered first.
    return (
        objects.where(F.octet_length(data) > 0)
        .select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
        .select(*rest, "no", F.expr(f"substring({data}, no * {size} + 1, {size})").alias("chunk"))
    )


def effective_range(size: Column, first: Column, last: Column, suffix: Column) -> Column:
    """Struct (start, end), inclusive. ``suffix`` >= 0 asks for the last bytes, else ``first`` to ``last`` (-1: to the end)."""
    start = F.when(suffix >= 0, F.greatest(size - suffix, F.lit(0))).otherwise(F.greatest(first, F.lit(0)))
    end = F.when((suffix >= 0) | (last < 0), size - 1).otherwise(F.least(last, size - 1))
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def range_status(size: Column, r: Column) -> Column:
    """Struct (status, length, content_range) of a ranged read; an empty object yields an empty body."""
    bad = (size > 0) & ((r["start"] > r["end"]) | (r["start"] >= size))
    length = F.when(bad | (size == 0), 0).otherwise(r["end"] - r["start"] + 1)
    text = F.when(~bad & (size > 0), F.concat(F.lit("bytes "), r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit("/"), size.cast("string")))
    return F.struct(F.when(bad, 416).otherwise(206).alias("status"), length.cast("long").alias("length"), text.alias("content_range"))


def segments(parts: Column, part_ends: Column, file_id: Column, size: Column) -> Column:
    """Array of (file_id, base, len): the parts of a multipart object in order, or the one file of a plain one."""
    whole = F.array(F.struct(file_id.cast("long").alias("file_id"), F.lit(0).cast("long").alias("base"), size.cast("long").alias("len")))
    base = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(part_ends, i - 1))
    many = F.transform(parts, lambda p, i: F.struct(p.cast("long").alias("file_id"), base(i).alias("base"), (F.get(part_ends, i) - base(i)).alias("len")))
    return F.when(F.coalesce(F.size(parts) == F.size(part_ends), F.lit(False)), many).otherwise(whole)


def plan_pieces(requests: DataFrame, step: int = 1034, size: int = CHUNK) -> DataFrame:
    """From rows (.., segments, start, end): rows (.., file_id, base, len, lo, hi), chunk numbers of at most ``step`` rows each.

    Segments that are empty or lie outside of the range have no piece.
    """
    rest = [c for c in requests.columns if c != "segments"]
    seg = requests.select(*rest, F.explode("segments").alias("s")).where("s.len > 0 and s.base <= end and s.base + s.len > start")
    lo = F.expr(f"(greatest(start, s.base) - s.base) div {size}")
    hi = F.expr(f"(least(end, s.base + s.len - 1) - s.base) div {size}")
    return (
        seg.withColumn("a", lo).withColumn("z", hi)
        .select(*rest, "s.file_id", "s.base", "s.len", F.explode(F.sequence("a", "z", F.lit(step).cast("long"))).alias("lo"), "z")
        .withColumn("hi", F.least(F.col("lo") + step - 1, F.col("z"))).drop("z")
    )


def sliced(chunk: Column, no: Column, base: Column, start: Column, end: Column, size: int = CHUNK) -> Column:
    """The part of a chunk row inside the range."""
    at = base + no * size
    skip = F.greatest(start - at, F.lit(0)).cast("int")
    take = (F.least(end - at, F.lit(size - 1)) - skip + 1).cast("int")
    return F.substring(chunk, skip + 1, take)


def reassemble(rows: DataFrame, by: list[str], order: list[str], data: str = "piece", expected: str = "expected") -> DataFrame:
    """Bytes of each group in order; raises where rows are missing, so a short body is never returned."""
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, data))).alias("rows"), F.max(expected).alias(expected))
    body = F.aggregate("rows", F.lit(b""), lambda acc, r: F.concat(acc, r[data]))
    whole = F.when(F.octet_length("body") == F.col(expected), F.col("body")).otherwise(F.raise_error(F.lit("chunk rows are missing")))
    return gathered.withColumn("body", body).select(*by, whole.alias("body"))


def multipart_etag(part_no: Column, part_sha: Column) -> Column:
    """Aggregate: SHA-256 over the raw part digests in part order, lower hex."""
    ordered = F.array_sort(F.collect_list(F.struct(part_no.alias("n"), part_sha.alias("h"))))
    return F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")), 256)


def range_header(header: str | None) -> tuple[int, int, int]:
    """(first, last, suffix) of ``bytes=a-b``, ``bytes=a-``, ``bytes=-n`` or none."""
    if not header:
        return 0, -1, -1
    unit, _, spec = header.partition("=")
    first, dash, last = spec.strip().partition("-")
    if unit.strip() != "bytes" or not dash or "," in spec or not (first or last):
        raise ValueError(f"not a single byte range: {header!r}")
    return (0, -1, int(last)) if not first else (int(first), int(last) if last else -1, -1)
