import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.functions import chunking as C

SIZES = [0, 1, 8119, 8120, 8121, 16240, 8120 * 2 + 23]


def body(n):
    return bytes(i * 7 % 251 for i in range(n))


def test_framing_and_round_trip(spark):
    df = spark.createDataFrame([(n, bytearray(body(n))) for n in SIZES], "size long, data binary")
    rows = C.chunk_rows(df).collect()
    for n in SIZES:
        own = sorted((r.no, bytes(r.chunk)) for r in rows if r.size == n)
        assert len(own) == -(-n // 8120) and b"".join(c for _, c in own) == body(n)
        assert [no for no, _ in own] == list(range(len(own)))


@pytest.mark.parametrize("header,size,want", [
    (None, 100, (0, 99)), ("bytes=8117-8140", 20000, (8117, 8140)), ("bytes=5-", 10, (5, 9)), ("bytes=-3", 10, (7, 9)), ("bytes=-30", 10, (0, 9)), ("bytes=2-500", 10, (2, 9)), ("bytes=12-20", 10, (12, 9)),
])
def test_effective_range(spark, header, size, want):
    first, last, suffix = C.range_header(header)
    r = spark.range(1).select(C.effective_range(*(F.lit(v) for v in (size, first, last, suffix))).alias("r")).first().r
    assert (r.start, r.end) == want


def test_bad_headers():
    for h in ("bytes=", "bytes=1-2,4-5", "lines=1-2", "bytes=x-1"):
        with pytest.raises(ValueError):
            C.range_header(h)


@pytest.mark.parametrize("start,end", [(0, 0), (8119, 8120), (8117, 8140), (0, 30000), (16240, 30010), (24000, 24001)])
def test_planned_read_over_segments(spark, start, end):
    parts = {11: body(8120 * 2 + 7), 12: b"", 13: body(9000)[::-1], 14: body(5000)}
    whole, ends = b"".join(parts.values()), []
    for p in parts.values():
        ends.append((ends[-1] if ends else 0) + len(p))
    end = min(end, len(whole) - 1)
    req = spark.createDataFrame([(1, list(parts), ends, start, end)], "q long, parts array<long>, part_ends array<long>, start long, end long")
    req = req.withColumn("segments", C.segments(F.col("parts"), F.col("part_ends"), F.lit(0), F.lit(0))).drop("parts", "part_ends")
    chunks = C.chunk_rows(spark.createDataFrame([(k, bytearray(v)) for k, v in parts.items()], "file_id long, data binary"))
    plan = C.plan_pieces(req, step=1)
    rows = plan.join(chunks, "file_id").where("no between lo and hi").select(
        "q", "base", "no", C.sliced(F.col("chunk"), F.col("no"), F.col("base"), F.col("start"), F.col("end")).alias("piece"), (F.col("end") - F.col("start") + 1).alias("expected"))
    out = C.reassemble(rows, ["q"], ["base", "no"]).first().body
    assert bytes(out) == whole[start : end + 1]


def test_missing_rows_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, bytearray(b"ab"), 5)], "q long, no int, piece binary, expected long")
    with pytest.raises(Exception, match="missing"):
        C.reassemble(rows, ["q"], ["no"]).collect()


def test_empty_object_has_no_content_range(spark):
    r = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))
    s = spark.range(1).select(C.range_status(F.lit(0), r).alias("s")).first().s
    assert (s.status, s.length, s.content_range) == (206, 0, None)


def test_multipart_etag(spark):
    parts = [(2, b"two"), (1, b"one"), (10, b"ten")]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in parts], "n int, d binary")
    got = df.agg(C.multipart_etag(F.col("n"), F.sha2("d", 256)).alias("e")).first().e
    assert got == hashlib.sha256(b"".join(hashlib.sha256(d).digest() for _, d in sorted(parts))).hexdigest()


def test_range_reads_span_parts(spark, sf, monkeypatch):
    from tidewell.plans import storage

    asked, plan = [], C.plan_pieces
    monkeypatch.setattr(C, "plan_pieces", lambda requests, **options: asked.append(requests) or plan(requests, **options))
    storage.queries()["range_reads"](spark, sf)
    segments = [r.segments for r in asked[0].collect()]
    assert {len(s) for s in segments} == {1, 4} and any(x.len == 0 for s in segments for x in s)
    bases = plan(asked[0], step=2).groupBy("doc_id").agg({"base": "count"}).collect()
    assert max(r[1] for r in bases) > 1
