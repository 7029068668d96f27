import json
import math

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search as S
from tidewell.operators import telemetry as T
from tidewell.operators.versions import expiry_budget, expiry_takes


def test_corpus_is_deterministic():
    a, b = S.corpus_lines(100), S.corpus_lines(100)
    assert a == b and len(a.splitlines()) == 100
    docs = [json.loads(x) for x in a.splitlines()]
    assert [d["timestamp_nanos"] for d in docs] == list(range(S.EPOCH, S.EPOCH + 100))


def test_queries_over_the_corpus(spark):
    docs = S.corpus(300)
    df = spark.createDataFrame(docs, S.LOG_SCHEMA)
    total = lambda q: S.total(df, S.parse(q) if isinstance(q, str) else q).first().num_hits
    assert total("*") == 300
    assert total("severity_text:ERROR AND service_name:cart") == sum(d["severity_text"] == "ERROR" and d["service_name"] == "cart" for d in docs)
    assert total("body.message~:TIMEOUT") == sum("timeout" in d["body"]["message"] for d in docs)
    assert total("body.message~:time") == 0
    assert total("attributes.host:web-03 AND attributes.duration_ms:>100") == sum(d["attributes"]["host"] == "web-03" and d["attributes"]["duration_ms"] > 100 for d in docs)
    half, closed = S.TimeWindow("timestamp_nanos", S.EPOCH + 10, S.EPOCH + 20), S.TimeWindow("timestamp_nanos", S.EPOCH + 10, S.EPOCH + 20, closed=True)
    assert (total(half), total(closed)) == (10, 11)
    top = S.top(df, S.parse("severity_text:INFO"), [F.desc("timestamp_nanos")], 5).collect()
    assert [r.timestamp_nanos for r in top] == sorted((d["timestamp_nanos"] for d in docs if d["severity_text"] == "INFO"), reverse=True)[:5]
    timed = S.run(df, {"all": S.parse("*")}, "timestamp_nanos", S.windows(2, S.EPOCH, 300))
    assert [r["num_hits"] for r in timed] == [30, 30]
    for a, b in S.windows(50, 1000, 500):
        assert b - a == 50 and 1000 <= a and b <= 1500


def test_term_reaches_the_scan(spark, sf):
    plan = S.hits(spark.read.parquet(f"{sf}/events.parquet"), S.parse("event_type:click"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan


def test_buckets_and_percentiles(spark):
    values = [0, 1, 2, 3, 5, 100, 1000, 10**9, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.v: r.b for r in df.select("v", T.latency_bucket(F.col("v")).alias("b")).collect()}
    assert got == {v: min(127, math.floor(math.log2(max(v, 1)) * 4)) for v in values}
    p = T.bucket_percentile(T.histogram(df, F.col("v")), 0.5).first().ms
    assert p == pytest.approx(2 ** ((got[5] + 1) / 4) / 1000)
    assert [r.ms for r in T.bucket_percentile(T.histogram(df.limit(0), F.col("v")), 0.5).collect()] == [0.0]


def test_counters(spark):
    a = spark.createDataFrame([("x", 5, 1), ("y", 9, 9), ("z", 1, 1)], "instance string, gets long, mib long")
    b = spark.createDataFrame([("x", 8, 2), ("y", 3, 10), ("w", 1, 1)], "instance string, gets long, mib long")
    assert [tuple(r) for r in T.counter_diff(a, b, ["gets", "mib"]).collect()] == [("x", 3, 1)]
    reads = spark.createDataFrame([(1000, 500, 900), (9 << 20, 2000, 70_000), (70 << 10, 500, 900)], "size long, ttfb long, total long")
    line = T.stats_lines(reads, F.col("size"), F.col("ttfb"), F.col("total"), "ab-12", pid=7, parts=3, wait_us=1500)
    assert line.first().line.startswith(
        "perf: pid=7 instance=ab-12 spans=[<64K:1 <512K:1 <2M:0 <8M:0 >=8M:1] small n=2 ttfb=1ms total=2ms | stream n=1 ttfb=2ms total=70ms | parts=3 wait(sum)=2ms | served=9MiB | get p50=")
    none = T.stats_lines(reads.limit(0), F.col("size"), F.col("ttfb"), F.col("total"), "x")
    assert none.first().line.endswith("| served=0MiB | get p50=0.0ms p95=0.0ms p99=0.0ms")
    lines = line.union(none).union(spark.createDataFrame([("nothing",)], "line string"))
    assert [r.s and tuple(r.s) for r in lines.select(T.parse_stats(F.col("line")).alias("s")).collect()] == [(9, 3, "ab-12"), (0, 0, "x"), None]


def test_expiry_budget_bounds(spark):
    df = spark.createDataFrame([(i, 10) for i in range(100)], "id long, n long")
    assert expiry_budget(df, [F.col("id")], "n", rows=35).count() == 3
    assert expiry_budget(df, [F.col("id")], "n", rows=8192, visits=64).count() == 64
    with pytest.raises(ValueError):
        expiry_budget(df, [F.col("id")], "n", rows=9000)


def test_expiry_goes_on_inside_a_large_upload(spark):
    left, runs = {0: 25, 1: 0, 2: 4, 3: 10}, []
    while left:
        df = spark.createDataFrame(list(left.items()), "id long, n long")
        takes = {r.id: r.take for r in expiry_takes(df, [F.col("id")], "n", rows=10).collect()}
        runs.append(takes)
        left = {k: n - takes.get(k, 0) for k, n in left.items() if takes.get(k) != n}
        assert len(runs) < 9
    assert runs == [{0: 10}, {0: 10}, {0: 5, 1: 0, 2: 4, 3: 1}, {3: 9}]


def test_exact_percentiles(spark):
    import random

    rng = random.Random(5)
    groups = {"hot": [7.0] * 4000 + [rng.random() * 9 for _ in range(3000)], "few": [3.0], "two": [1.0, 2.0], None: [rng.gauss(0, 1) for _ in range(500)], "ties": [1.0, 1.0, 1.0, 2.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, x double").repartition(5)
    ps = (0.0, 0.01, 0.5, 0.95, 0.99, 1.0)
    ranks = {f"{name}{int(p * 100)}": (rule, p) for p in ps for name, rule in (("f", T.rank_floor), ("i", T.rank_index), ("c", T.rank_ceil))}
    got = {r.g: r.asDict() for r in T.exact_percentiles(df, "x", ["g"], ranks).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs, n = sorted(xs), len(xs)
        for p in ps:
            want = {"f": xs[math.floor((n - 1) * p)], "i": xs[min(n - 1, int(n * p))], "c": xs[max(0, math.ceil(n * p) - 1)]}
            assert {k: got[g][f"{k}{int(p * 100)}"] for k in want} == want, (g, p)
    assert T.exact_percentiles(df.limit(0), "x", ["g"], ranks).count() == 0


def test_lock_keys_and_intervals(spark):
    from tidewell.functions import times as TM

    row = spark.range(1).select(
        TM.lock_key(F.lit("a"), F.lit("b")).alias("ab"), TM.lock_key(F.lit("b"), F.lit("a")).alias("ba"), TM.lock_key(F.lit("a"), F.lit("b")).alias("again"),
        TM.seconds(F.expr("timestamp'2024-03-01 00:00:00.5' - timestamp'2024-03-02 12:00:00'")).alias("back"), TM.epoch(F.expr("timestamp'1970-01-02 00:00:00.25'")).alias("day")).first()
    assert row.ab == row.again != row.ba and (row.back, row.day) == (-129599.5, 86400.25)


def test_index_discovery(spark, tmp_path):
    for name, n in (("logs-a", 3), ("logs-b", 0), ("other", 2)):
        spark.range(n).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, S.indices(spark, str(tmp_path), "logs*").collect())) == [("logs-a", 3), ("logs-b", 0)]
    assert S.indices(spark, str(tmp_path), "none*").collect() == []


def test_progress_lines(spark, tmp_path):
    import time

    from tidewell.streaming import ingest

    spark.range(5).write.parquet(f"{tmp_path}/in")
    lines = []
    log = ingest.ProgressLog(lines.append)
    spark.streams.addListener(log)
    try:
        ingest.append_new(ingest.stream_table(spark, f"{tmp_path}/in", "id long"), f"{tmp_path}/out", f"{tmp_path}/cp", "id").awaitTermination()
        for _ in range(100):
            if any(x.startswith("ended") for x in lines):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert lines[0].startswith("started") and any(": 5 rows," in x for x in lines) and lines[-1].startswith("ended")
