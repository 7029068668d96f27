import hashlib
import re
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import chunking as C
from tidewell.functions.prng import filler_objects
from tidewell.sources import objectstore as S

OLD, NEW = b"A" * (8120 * 2 + 23), b"B" * (8120 * 3 + 31)


@pytest.fixture()
def store(spark, tmp_path):
    s = S.ObjectStore(spark, f"file://{tmp_path}/store")
    s.create_bucket("b")
    return s


def test_bucket_lifecycle(store):
    with pytest.raises(S.NoSuchBucket):
        store.put("x", "k", b"1")
    store.create_bucket("a")
    store.create_bucket("a")
    assert store.list_buckets() == ["a", "b"]
    store.put("a", "k", b"hello world")
    with pytest.raises(S.BucketNotEmpty):
        store.delete_bucket("a")
    store.delete("a", "k")
    upload = store.create_upload("a", "k")
    with pytest.raises(S.BucketNotEmpty):
        store.delete_bucket("a")
    store.abort_upload(upload, "a", "k")
    store.delete_bucket("a")
    assert store.list_buckets() == ["b"] and not store.head_bucket("a")
    with pytest.raises(S.NoSuchBucket):
        store.head("a", "k")
    with pytest.raises(S.NoSuchKey):
        store.head("b", "k")


def test_overwrite_ranges_and_delete(store):
    store.put("b", "k", OLD)
    assert store.get("b", "k", "bytes=8117-8140").data == OLD[8117:8141]
    meta = store.put("b", "k", NEW)
    assert store.head("b", "k") == meta and meta.etag == hashlib.sha256(NEW).hexdigest()
    got = store.get("b", "k", f"bytes={len(OLD)}-{len(OLD) + 16}")
    assert got.data == NEW[len(OLD) : len(OLD) + 17] and got.content_range == f"bytes {len(OLD)}-{len(OLD) + 16}/{len(NEW)}"
    assert store.get("b", "k").data == NEW and store.get("b", "k", "bytes=-5").data == NEW[-5:]
    with pytest.raises(S.InvalidRange):
        store.get("b", "k", f"bytes={len(NEW)}-")
    assert store.stranded().count() == 3
    store.delete("b", "k")
    store.delete("b", "never")
    assert store.vacuum() == 7 and store.chunks().count() == 0


def test_empty_object(store):
    store.put("b", "e", b"")
    got = store.get("b", "e", "bytes=0-10")
    assert got.data == b"" and got.content_range is None


def test_conditions(store):
    first = store.put("b", "k", b"first", if_none_match="*")
    with pytest.raises(S.PreconditionFailed):
        store.put("b", "k", b"duplicate", if_none_match="*")
    second = store.put("b", "k", b"updated", if_match=f'"{first.etag}"')
    with pytest.raises(S.PreconditionFailed):
        store.put("b", "k", b"stale", if_match=f'"{first.etag}"')
    with pytest.raises(S.PreconditionFailed):
        store.put("b", "none", b"x", if_match=f'"{first.etag}"')
    for bad in ({"if_none_match": "abc"}, {"if_match": "W/\"x\""}, {"if_match": "*"}):
        with pytest.raises(S.BadRequest):
            store.put("b", "k", b"x", **bad)
    with pytest.raises(S.NotSupported):
        store.delete_many("b", ["k"], versioned=True)
    assert store.head("b", "k").etag == second.etag


def test_racing_creates_have_one_winner(store):
    out = []

    def go(i):
        try:
            out.append(("ok", store.put("b", "race", bytes([i]) * 9000, if_none_match="*").etag))
        except S.PreconditionFailed:
            out.append(("lost", None))

    threads = [threading.Thread(target=go, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [e for s, e in out if s == "ok"]
    assert len(won) == 1 and len(out) == 3 and store.head("b", "race").etag == won[0]


def test_bulk_put_and_delete(store, spark):
    store.put_many("b", filler_objects(spark, 6, 20_000))
    assert [m.key for m in store.list("b").keys] == [f"obj-{i:05d}.bin" for i in range(6)]
    assert len(store.get("b", "obj-00003.bin").data) == 20_000
    stat = store.stat()
    assert (stat["objects"], stat["logical"], stat["chunk_rows"], stat["payload"]) == (6, 120_000, 18, 120_000)
    store.delete_many("b", ["obj-00001.bin", "nope"])
    assert len(store.list("b").keys) == 5
    for bad in ([], [""], ["k"] * 1001):
        with pytest.raises(S.BadRequest):
            store.delete_many("b", bad)


def test_listing_pages_skip_nothing(store, spark):
    keys = [*(f"d{i}/x{j}" for i in range(3) for j in range(3)), "a", "b é", "z", "B"]
    store.put_many("b", spark.createDataFrame([(k, bytearray(b"1")) for k in keys], "key string, data binary"))
    seen, token = [], None
    while True:
        page = store.list("b", max_keys=4, token=token)
        seen += [m.key for m in page.keys]
        token = page.next_token
        if not page.truncated:
            break
    assert seen == sorted(keys, key=str.encode)
    page = store.list("b", delimiter="/")
    assert page.prefixes == ("d0/", "d1/", "d2/") and [m.key for m in page.keys] == ["B", "a", "b é", "z"]
    entries, token = [], None
    while True:
        page = store.list("b", delimiter="/", max_keys=1, token=token)
        entries += [*page.prefixes, *(m.key for m in page.keys)]
        token = page.next_token
        if not page.truncated:
            break
    assert entries == ["B", "a", "b é", "d0/", "d1/", "d2/", "z"]
    assert store.list("b", max_keys=0).keys == () and not store.list("b", max_keys=0).truncated
    assert [m.key for m in store.list("b", prefix="d1/", start_after="d1/x0").keys] == ["d1/x1", "d1/x2"]


def test_multipart(store):
    one, two = b"3" * (8120 * 4 + 1), b"4" * (8120 * 2 + 7)
    upload = store.create_upload("b", "m")
    assert store.create_upload("b", "m") == upload
    store.upload_part(upload, "b", "m", 1, b"wrong")
    e2 = store.upload_part(upload, "b", "m", 2, two)
    e1 = store.upload_part(upload, "b", "m", 1, one)
    with pytest.raises(S.NoSuchKey):
        store.head("b", "m")
    for bad in ([(1, e1)], [(1, e1), (2, e1)], [(1, e1), (2, e2), (3, e2)], []):
        with pytest.raises(S.InvalidPart):
            store.complete_upload(upload, "b", "m", bad)
    meta = store.complete_upload(upload, "b", "m", [(2, e2), (1, f'"{e1}"')])
    assert meta.etag == hashlib.sha256(bytes.fromhex(e1) + bytes.fromhex(e2)).hexdigest() and meta.size == len(one) + len(two)
    assert store.get("b", "m", f"bytes={len(one) - 10}-{len(one) + 9}").data == (one + two)[len(one) - 10 : len(one) + 10]
    assert store.complete_upload(upload, "b", "m", [(1, e1)]) == meta
    with pytest.raises(S.NoSuchUpload):
        store.upload_part(upload, "b", "m", 3, b"x")
    store.delete("b", "m")
    store.vacuum()
    assert store.chunks().count() == 0


def test_expiry_budget(store):
    ids = [store.create_upload("b", f"k{i}") for i in range(3)]
    for i, u in enumerate(ids):
        store.upload_part(u, "b", f"k{i}", 1, b"x" * 8120 * 10)
    assert store.expire_uploads() == 0
    assert store.expire_uploads(grace=timedelta(seconds=-60), rows=20) == 20
    assert [u.upload_id for u in store.uploads().collect()] == [ids[2]]
    with pytest.raises(ValueError):
        store.expire_uploads(rows=0)


def test_expiry_of_an_upload_larger_than_the_budget(store):
    big, young = store.create_upload("b", "big"), store.create_upload("b", "young")
    one, two = (store.upload_part(big, "b", "big", i, b"x" * (8120 * n - 5)) for i, n in ((1, 4), (2, 21)))
    store.upload_part(young, "b", "young", 1, b"y" * 8120 * 3)
    ask = lambda: store.expire_uploads(grace=timedelta(seconds=-60), rows=10)
    assert ask() == 10 and [(r.part_no, r.size) for r in store.upload_parts().where(F.col("upload_id") == big).collect()] == [(2, 8120 * 15)]
    for listed in ([(1, one), (2, two)], [(2, two)], [(2, "")]):
        with pytest.raises(S.InvalidPart):
            store.complete_upload(big, "b", "big", listed)
    assert store.vacuum() == 10 and store.chunks().count() == 18
    assert [ask() for _ in range(3)] == [10, 8, 0]
    assert store.uploads().isEmpty() and store.vacuum() == 18 and store.chunks().count() == 0


def test_layout_marker(spark, tmp_path):
    S.ObjectStore(spark, f"file://{tmp_path}/s")
    (tmp_path / "s" / "layout.json").write_text('{"version": 2}')
    with pytest.raises(S.StoreError, match="can't be read"):  # the checksum beside it no longer holds
        S.ObjectStore(spark, f"file://{tmp_path}/s")
    (tmp_path / "s" / ".layout.json.crc").unlink()
    with pytest.raises(S.StoreError, match="another layout version"):
        S.ObjectStore(spark, f"file://{tmp_path}/s")
    (tmp_path / "s" / "layout.json").unlink()
    with pytest.raises(S.StoreError):
        S.ObjectStore(spark, f"file://{tmp_path}/s")


def test_reads_prune_folders(store):
    meta = store.put("b", "k", OLD)
    store.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else Spark cuts long plans
    try:
        plan = store.read_pieces(meta, 0, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        store.spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*folder#\d+ = \d+", plan) and "GreaterThanOrEqual(no,0)" in plan


def test_folders_on_the_driver_are_those_of_the_scan(store, spark):
    ids = [0, 1, 7, 2**62, 2**63 - 1, *(i * 982_451_653 for i in range(200))]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", C.folder_of(F.col("id")).alias("f")).collect()
    assert all(store._folders([r.id]) == [r.f] for r in rows)


def test_many_parts_are_one_scan(store, spark):
    n = 10_000
    rows = spark.range(n).select(F.col("id").alias("file_id"), F.format_string("%06d", "id").cast("binary").alias("data"))
    store._write_chunks(rows)
    meta = S.Meta("b", "m", 0, 6 * n, "", 0.0, tuple(range(n)), tuple(6 * (i + 1) for i in range(n)))
    assert b"".join(store._pieces(meta, 4, 6 * n - 3)) == "".join(f"{i:06d}" for i in range(n)).encode()[4:-2]
    assert store.read_pieces(meta, 0, 6 * n - 1)._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    short = S.Meta("b", "m", 0, 6 * n + 6, "", 0.0, (*range(n), n), (*meta.part_ends, 6 * n + 6))
    with pytest.raises(S.StoreError, match="missing"):
        b"".join(store._pieces(short, 0, 6 * n + 5))


def test_a_vacuum_that_crashes_loses_nothing(store, monkeypatch):
    store.put("b", "keep", NEW)
    for i in range(12):
        store.put("b", "k", OLD + bytes([i]))
    before = store.chunks().count()
    create = store._create
    with monkeypatch.context() as m:
        m.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.vacuum()
    assert store._create == create and store.chunks().count() == before and store.get("b", "keep").data == NEW
    assert store.vacuum() == 33 and store.chunks().count() == 7
    assert store.get("b", "keep").data == NEW and store.get("b", "k").data == OLD + bytes([11])
    store.put("b", "new", OLD)
    store.delete("b", "k")
    assert store.vacuum() == 3 and store.get("b", "new").data == OLD and store.vacuum() == 0


def test_bulk_put_after_a_lost_race_is_the_newest(store, spark):
    store.put("b", "k", b"old")
    commit = store._commit

    def late(make):
        store._commit = commit
        store.put("b", "k", b"between")
        return commit(make)

    store._commit = late
    store.put_many("b", spark.createDataFrame([("k", bytearray(b"bulk")), ("k", bytearray(b"bulk"))], "key string, data binary"))
    assert store.get("b", "k").data == b"bulk" and b"".join(store.stream("b", "k", "bytes=1-2")) == b"ul"
    assert [(r.key, bytes(r.data)) for r in store.bodies("b").collect()] == [("k", b"bulk")]
    store.put("b", "k", b"")
    assert [(r.key, bytes(r.data)) for r in store.bodies("b").collect()] == [("k", b"")]
    store.delete("b", "k")
    store.delete_bucket("b")
    with pytest.raises(S.NoSuchBucket):
        store.put_many("b", spark.createDataFrame([("k", bytearray(b"1"))], "key string, data binary"))


def test_read_load(store):
    from tidewell.plans import storebench as B

    assert B.seed(store, "load", 90_000, 40_000) == 3
    out = B.matrix(store, "load", [4096], [1, 2], 4)
    assert [(r["concurrency"], r["requests"]) for r in out] == [(1, 4), (2, 4)] and all(r["req_s"] > 0 and r["p50_ms"] <= r["p99_ms"] for r in out)
    assert all(o % B.ALIGN == 0 and o + 4096 <= 40_000 for o in B.offsets(1, 50, 40_000, 4096))
    assert B.percentile([], 0.5) == 0.0 and B.percentile([3, 1, 2], 0.5) == 2
