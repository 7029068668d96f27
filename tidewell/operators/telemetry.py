"""Telemetry: size and latency histograms, the percentile definitions in use, rates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIB, MIB = 1 << 10, 1 << 20
#: Span classes by upper bound in bytes.
SPANS = ((64 * KIB, "<64K"), (512 * KIB, "<512K"), (2 * MIB, "<2M"), (8 * MIB, "<8M"))


def span_class(size: Column) -> Column:
    out = F.lit(">=8M")
    for bound, name in reversed(SPANS):
        out = F.when(size < bound, name).otherwise(out)
    return out


def latency_bucket(us: Column) -> Column:
    """Quarter-octave bucket of a latency in microseconds, 0 to 127."""
    return F.least(F.lit(127), F.floor(F.log2(F.greatest(us, F.lit(1)).cast("double")) * 4)).cast("int")


def bucket_value_ms(bucket: Column) -> Column:
    """Upper edge of a bucket in milliseconds."""
    return F.pow(F.lit(2.0), (bucket + 1) / 4) / 1000


def histogram(df: DataFrame, us: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), latency_bucket(us).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_percentile(hist: DataFrame, p: float, by: list[str] | None = None) -> DataFrame:
    """First bucket whose cumulative count reaches ceil(total * p), as its upper edge; at most 128 rows a group are windowed.

    Without ``by`` there is one row, 0 if the histogram is empty.
    """
    by = by or []
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    cum = hist.withColumn("cum", F.sum("n").over(part.orderBy("bucket"))).withColumn("total", F.sum("n").over(part))
    reached = cum.where(F.col("cum") >= F.ceil(F.col("total") * p))
    return reached.groupBy(*by).agg(F.min("bucket").alias("bucket")).select(*by, F.coalesce(bucket_value_ms(F.col("bucket")), F.lit(0.0)).alias("ms"))


def rank_floor(n: Column, p: float) -> Column:
    """Zero-based rank floor((n - 1) p)."""
    return F.floor((n - 1) * p).cast("long")


def rank_index(n: Column, p: float) -> Column:
    """Zero-based rank min(n - 1, int(n p))."""
    return F.least(n - 1, F.floor(n * p)).cast("long")


def rank_ceil(n: Column, p: float) -> Column:
    """Zero-based rank ceil(n p) - 1, 0 at least."""
    return F.greatest(F.ceil(n * p) - 1, F.lit(0)).cast("long")


#: Bins that a group is cut into to find a rank; a sorted run is about one of them.
BINS = 64


def exact_percentiles(df: DataFrame, x: str, by: list[str], ranks: dict[str, tuple]) -> DataFrame:
    """Rows (by.., one column per entry of ``ranks``): the exact sorted values of ``x`` at ranks given as (rule, p); nulls of ``x`` don't count.

    Approximate quantiles only cut each group into bins, whose exact counts say
    which bin holds a rank; values are counted map-side, and the running sum is
    over that bin's distinct values, so neither a large group nor a frequent value
    meets in one task.
    """
    have = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("x"))
    keyed = have.select(F.struct(*by).alias("g"), "x")
    edges = keyed.groupBy("g").agg(F.percentile_approx("x", [i / BINS for i in range(1, BINS)], 100 * BINS).alias("edges"))
    binned = keyed.groupBy("g", "x").agg(F.count("*").alias("c")).join(edges, "g").select("g", "x", "c", F.size(F.filter("edges", lambda e: e < F.col("x"))).alias("bin"))
    whole = Window.partitionBy("g")  # as many rows as bins
    bins = binned.groupBy("g", "bin").agg(F.sum("c").alias("m")).withColumn("n", F.sum("m").over(whole)).withColumn("before", F.sum("m").over(whole.orderBy("bin")) - F.col("m"))
    wanted = bins.select("g", "bin", "before", "m", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rule(F.col("n"), p).alias("rank")) for name, (rule, p) in ranks.items()))).alias("w"))
    wanted = wanted.where("w.rank >= before and w.rank < before + m").select("g", "bin", "w.name", (F.col("w.rank") - F.col("before")).alias("rank"))
    at = Window.partitionBy("g", "name").orderBy("x")
    found = binned.join(wanted, ["g", "bin"]).withColumn("upto", F.sum("c").over(at)).where("upto > rank")
    return found.groupBy("g").agg(*(F.min(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks)).select("g.*", *ranks)


def class_counters(df: DataFrame, size: Column, ttfb: Column, total: Column) -> DataFrame:
    """Counts and sums of small (up to 8 MiB) and large reads."""
    return df.groupBy(F.when(size <= 8 * MIB, 0).otherwise(1).alias("class")).agg(
        F.count("*").alias("n"), F.sum(ttfb).cast("long").alias("ttfb_us"), F.sum(total).cast("long").alias("total_us"), F.sum(size).cast("long").alias("bytes"))


def throughput(n: Column, size: Column, wall_s: Column) -> Column:
    """Struct (mib_s, req_s); a wall time of zero counts as a nanosecond."""
    wall = F.greatest(wall_s, F.lit(1e-9))
    return F.struct((size * n / MIB / wall).alias("mib_s"), (n / wall).alias("req_s"))


def share_below(x: Column, bound: float) -> Column:
    """Aggregate: percentage of values below a bound, one decimal."""
    return F.round(F.avg(F.when(x < bound, 100.0).otherwise(0.0)), 1)


def counter_diff(before: DataFrame, after: DataFrame, counters: list[str], instance: str = "instance") -> DataFrame:
    """after - before per instance; only instances in both, and only where no counter went back (a restart)."""
    b = before.select(F.col(instance), *(F.col(c).alias(f"{c}_before") for c in counters))
    diff = after.join(b, instance).select(instance, *((F.col(c) - F.col(f"{c}_before")).alias(c) for c in counters))
    return diff.where(" and ".join(f"{c} >= 0" for c in counters))


# The telemetry line, and what is read from it.
STATS_FORMAT = (
    "perf: pid={pid} instance={instance} spans=[<64K:{s0} <512K:{s1} <2M:{s2} <8M:{s3} >=8M:{s4}]"
    " small n={small_n} ttfb={small_ttfb:.0f}ms total={small_total:.0f}ms | stream n={stream_n} ttfb={stream_ttfb:.0f}ms total={stream_total:.0f}ms"
    " | parts={parts} wait(sum)={wait:.0f}ms | served={served}MiB | get p50={p50:.1f}ms p95={p95:.1f}ms p99={p99:.1f}ms"
)
STATS_LINE = r"instance=([^ ]+).*small n=(\d+) .*\| stream n=(\d+) .* served=(\d+)MiB"


def parse_stats(line: Column) -> Column:
    """Struct (mib, gets, instance) of a telemetry line, null if it is none; gets are those of both classes."""
    part = lambda i: F.regexp_extract(line, STATS_LINE, i)
    gets = part(2).cast("long") + part(3).cast("long")
    return F.when(line.rlike(STATS_LINE), F.struct(part(4).cast("long").alias("mib"), gets.alias("gets"), part(1).alias("instance")))


def stats_lines(reads: DataFrame, size: Column, ttfb: Column, total: Column, instance: str, pid: int = 0, parts: int = 0, wait_us: int = 0) -> DataFrame:
    """One row (line): the telemetry line of reads with sizes in bytes and times in microseconds.

    Empty input gives the line with zeros.
    """
    kind = F.when(size <= 8 * MIB, "small").otherwise("stream")
    ms = lambda c, k: F.coalesce(F.sum(F.when(kind == k, c)) / 1000, F.lit(0.0))
    spans = [F.count(F.when(span_class(size) == name, 1)).alias(f"s{i}") for i, name in enumerate((*(n for _, n in SPANS), ">=8M"))]
    sums = [x.alias(f"{k}_{n}") for k in ("small", "stream") for n, x in (("n", F.count(F.when(kind == k, 1))), ("ttfb", ms(ttfb, k)), ("total", ms(total, k)))]
    totals = reads.agg(*spans, *sums, F.floor(F.coalesce(F.sum(size), F.lit(0)) / MIB).cast("long").alias("served"))
    hist = histogram(reads, total)
    for p in (50, 95, 99):
        totals = totals.crossJoin(F.broadcast(bucket_percentile(hist, p / 100).withColumnRenamed("ms", f"p{p}")))  # one row by one row
    given = {"pid": F.lit(pid), "instance": F.lit(instance), "parts": F.lit(parts), "wait": F.lit(wait_us / 1000)}
    pieces = []
    for text, name, form, _ in Formatter().parse(STATS_FORMAT):
        pieces.append(F.lit(text))
        if name:
            value = given.get(name, F.col(name))
            pieces.append(F.format_string(f"%{form}", value.cast("double")) if form else value.cast("string"))
    return totals.select(F.concat(*pieces).alias("line"))
