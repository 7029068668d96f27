import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import prng
from tidewell.operators import search as S
from tidewell.plans import runner
from tidewell.sources.lake import Lake, read_glob, retype_hits
from tidewell.streaming import ingest


def test_lake_load_and_view(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    assert lake.load("t", spark.range(10)) == 10
    assert lake.load("t", spark.range(5)) == 5
    assert lake.load("t", spark.range(99), views_only=True) == 5
    assert spark.table("t").count() == 5 and lake.view("t").count() == 5
    assert Lake(spark).load("m", spark.range(3)) == 3


def test_glob_and_retyping(spark, tmp_path):
    raw = spark.createDataFrame([(19723, 1704067261, bytearray(b"http://x"))], "EventDate int, EventTime long, URL binary")
    raw.coalesce(1).write.parquet(f"{tmp_path}/h")
    df = retype_hits(read_glob(spark, f"{tmp_path}/h", "part-*.parquet", binary_as_string=True))
    r = df.first()
    assert (str(r.EventDate), str(r.EventTime), r.URL) == ("2024-01-01", "2024-01-01 00:01:01", "http://x")


def test_query_numbers():
    assert runner.select_numbers("1-3,6", 43) == [1, 2, 3, 6]
    assert runner.select_numbers(None, 3) == [1, 2, 3]
    for bad in ("0", "5-4", "44", "x", "1-"):
        with pytest.raises(ValueError):
            runner.select_numbers(bad, 43)


def test_timeout_cancels(spark):
    slow = lambda: spark.range(200, numPartitions=4).select(F.udf(lambda i: time.sleep(0.2) or i, "long")("id"))
    with pytest.raises(runner.QueryTimeout):
        runner.run_one(spark, slow, timeout=1)
    assert runner.run_one(spark, lambda: spark.range(3))[0] == 3


def test_passes(spark, sf, tmp_path):
    out = runner.run_passes(spark, {"good": lambda s, d: s.range(2), "bad": lambda s, d: s.table("no_such")}, sf)
    assert [list(p["queries"]) for p in out] == [["good"], ["good"]] and list(out[0]["failed"]) == ["bad"]
    runner.write_jsonl(out, f"{tmp_path}/r.jsonl")
    assert len(open(f"{tmp_path}/r.jsonl").readlines()) == 2


def test_generator(spark):
    z = prng.sequence(42, 3)
    assert int(z[0]) == 13679457532755275413
    assert [r.v for r in spark.range(3).select(prng.nth(42, F.col("id")).alias("v")).collect()] == [str(v) for v in z]
    assert prng.filler(1, 20)[:8] == prng.filler(1, 8) and len(prng.filler(1, 20)) == 20


def test_create_only_ingest(spark, tmp_path):
    src, out, ck = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck"
    spark.range(0, 100, numPartitions=4).withColumn("x", F.lit(1)).write.parquet(src)
    for _ in range(2):
        ingest.append_new(ingest.stream_table(spark, src, "id long, x int", 2), out, ck, "id").awaitTermination()
        assert ingest.visible(spark, out) == 100
    spark.range(50, 150, numPartitions=2).withColumn("x", F.lit(2)).write.mode("append").parquet(src)
    ingest.append_new(ingest.stream_table(spark, src, "id long, x int", 2), out, ck, "id").awaitTermination()
    assert ingest.visible(spark, out) == 150 and spark.read.parquet(out).where("x = 2").count() == 50


def test_bad_json_fails_whole(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.json").write_text(S.corpus_lines(20))
    assert ingest.ingest_json(spark, str(tmp_path / "logs"), S.LOG_SCHEMA).count() == 20
    (tmp_path / "logs" / "b.json").write_text('{"timestamp_nanos": 1}\n{broken\n')
    with pytest.raises(Exception):
        ingest.ingest_json(spark, str(tmp_path / "logs"), S.LOG_SCHEMA).collect()


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(f"{tmp_path}/ev")
    q = ingest.windowed_counts(ingest.stream_table(spark, f"{tmp_path}/ev", schema), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))


def test_conditional_writes_take_every_event(spark, sf):
    from tidewell.plans import storage

    e = spark.read.parquet(f"{sf}/events.parquet").collect()
    state = {}
    for r in sorted((r for r in e if r.event_id % 2 == 0), key=lambda r: r.event_id):
        state[r.user_id] = None if r.event_type == "error" else r.event_id
    want = {}
    for r in e:
        if r.event_id % 2:
            tag = state.get(r.user_id)
            asked = tag if r.event_id % 4 == 1 else r.event_id
            fails = {0: False, 1: tag is not None, 2: tag is None or tag != asked}[r.event_id % 3]
            want[r.event_id] = 412 if fails else 200
    got = storage.queries()["conditional_writes"](spark, sf).collect()
    assert {r.event_id: r.status for r in got} == want and len(got) == len(want)
    assert set(state) | {r.key for r in got} == {r.user_id for r in e} and len(want) + sum(r.event_id % 2 == 0 for r in e) == len(e)
    assert {(r.event_id % 3, r.status) for r in got} >= {(0, 200), (1, 200), (1, 412), (2, 200), (2, 412)}
