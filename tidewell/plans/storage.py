"""Queries of the chunk, listing, mutation, search and telemetry operators, with oracle SQL.

``documents.text`` as UTF-8 stands for object bytes, ``pages.url`` for keys,
``conversations`` for uploads and their parts, ``events`` for versions, logs and
latencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import chunking as C
from tidewell.functions import times as TM
from tidewell.operators import search as S
from tidewell.operators import telemetry as T
from tidewell.operators.listing import list_page
from tidewell.operators.versions import complete_check, conditional_puts, expiry_budget, expiry_takes, latest
from tidewell.sources.objectstore import ObjectStore, StoreError
from tidewell.sources.scratch import kept, scratch
from tidewell.sources.tables import TABLES, table

_QUERIES, _SQL = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


_HEXED = "o AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS size FROM documents)"


@_query(f"""WITH {_HEXED}, c AS (SELECT doc_id, hx, size, unnest(range((size + 8119) // 8120)) AS no FROM o WHERE size > 0)
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(least(8120, size - no * 8120) AS INTEGER) AS len, sha256(unhex(substr(hx, no * 16240 + 1, 16240))) AS sha FROM c""")
def chunk_frames(spark, sf_dir):
    """CHK1, CHK11: framing into 8120-byte rows, each with its hash."""
    return C.chunk_rows(_objects(spark, sf_dir)).select("doc_id", "no", F.octet_length("chunk").alias("len"), F.sha2("chunk", 256).alias("sha"))


_REQUEST = "CASE WHEN doc_id % 5 = 0 THEN -1 WHEN doc_id % 5 = 1 THEN 20 ELSE -1 END AS suffix, doc_id % 97 * 83 AS first, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 97 * 83 + doc_id % 101 * 131 END AS last"
_RANGED = f"""{_HEXED}, q AS (SELECT *, {_REQUEST} FROM o),
r AS (SELECT *, CASE WHEN suffix >= 0 THEN greatest(size - suffix, 0) ELSE greatest(first, 0) END AS "start", CASE WHEN suffix >= 0 OR last < 0 THEN size - 1 ELSE least(last, size - 1) END AS "end" FROM q)"""


def _ranged(spark, sf_dir):
    sized = _objects(spark, sf_dir).withColumn("size", F.octet_length("data").cast("long"))
    asked = sized.selectExpr("*", *(p.strip() for p in ["case when doc_id % 5 = 0 then -1 when doc_id % 5 = 1 then 20 else -1 end as suffix", "doc_id % 97 * 83 as first", "case when doc_id % 3 = 0 then -1 else doc_id % 97 * 83 + doc_id % 101 * 131 end as last"]))
    return asked.withColumn("r", C.effective_range(F.col("size"), F.col("first"), F.col("last"), F.col("suffix")))


@_query(f"""WITH {_RANGED}
SELECT doc_id, CAST(CASE WHEN size > 0 AND ("start" > "end" OR "start" >= size) THEN 416 ELSE 206 END AS INTEGER) AS status,
  CAST(CASE WHEN size = 0 OR "start" > "end" OR "start" >= size THEN 0 ELSE "end" - "start" + 1 END AS BIGINT) AS length,
  CASE WHEN size > 0 AND "start" <= "end" AND "start" < size THEN 'bytes ' || "start" || '-' || "end" || '/' || size END AS content_range FROM r""")
def range_metadata(spark, sf_dir):
    """CHK2, CHK3, CHK15: effective range and response metadata."""
    return _ranged(spark, sf_dir).select("doc_id", C.range_status(F.col("size"), F.col("r")).alias("s")).select("doc_id", "s.*")


@_query(f"""WITH {_RANGED} SELECT doc_id, sha256(unhex(substr(hx, CAST("start" * 2 + 1 AS BIGINT), CAST(("end" - "start" + 1) * 2 AS BIGINT)))) AS sha, CAST("end" - "start" + 1 AS BIGINT) AS n
FROM r WHERE "start" <= "end" AND "start" < size""")
def range_reads(spark, sf_dir):
    """CHK4-CHK9: plan pieces, scan chunk rows by number, slice, reassemble in order with a completeness check.

    Three of four documents are stored as four parts, the second of them empty.
    """
    size = F.octet_length("data").cast("long")
    cuts = [F.lit(0).cast("long"), F.floor(size / 3), F.floor(size / 3), F.floor(size * 2 / 3), size]
    many, file = F.col("doc_id") % 4 != 0, (F.col("doc_id") * 4).cast("long")
    parts, ends = F.when(many, F.array(*(file + i for i in range(4)))), F.when(many, F.array(*cuts[1:]))
    asked = _ranged(spark, sf_dir).where("r.start <= r.end and r.start < size")
    plan = C.plan_pieces(asked.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), C.segments(parts, ends, file, F.col("size")).alias("segments")), step=2)
    piece = lambda i: F.struct((file + i).alias("file_id"), F.substring("data", (cuts[i] + 1).cast("int"), (cuts[i + 1] - cuts[i]).cast("int")).alias("data"))
    files = F.when(many, F.array(*map(piece, range(4)))).otherwise(F.array(F.struct(file.alias("file_id"), F.col("data"))))
    chunks = C.chunk_rows(_objects(spark, sf_dir).select(F.explode(files).alias("f")).select("f.*"))
    rows = plan.join(chunks, "file_id").where("no between lo and hi")
    rows = rows.select("doc_id", "base", "no", C.sliced(F.col("chunk"), F.col("no"), F.col("base"), F.col("start"), F.col("end")).alias("piece"), (F.col("end") - F.col("start") + 1).alias("expected"))
    return C.reassemble(rows, ["doc_id"], ["base", "no"]).select("doc_id", F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("n"))


@_query("""SELECT conv_id, sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) AS etag, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size, count(*) AS n_parts FROM conversations GROUP BY conv_id""")
def multipart_etags(spark, sf_dir):
    """CHK12: hash of raw part digests in part order."""
    parts = table(spark, sf_dir, "conversations")
    return parts.groupBy("conv_id").agg(C.multipart_etag(F.col("turn"), F.sha2("text", 256)).alias("etag"), F.sum(F.octet_length("text")).cast("long").alias("size"), F.count("*").alias("n_parts"))


@_query("""SELECT conv_id, turn, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS part_end FROM conversations""")
def multipart_ends(spark, sf_dir):
    """CHK13: running part ends."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text")).over(w).cast("long").alias("part_end"))


@_query("""WITH k AS (SELECT url AS key, CASE WHEN instr(substr(url, 9), '/') > 0 THEN substr(url, 1, 8 + instr(substr(url, 9), '/')) END AS p FROM pages WHERE starts_with(url, 'https://'))
SELECT coalesce(p, key) AS entry, p IS NOT NULL AS is_prefix FROM k GROUP BY 1, 2 ORDER BY entry LIMIT 100""")
def list_delimited(spark, sf_dir):
    """LST2, LST4: prefix listing with delimiter roll-up."""
    return list_page(table(spark, sf_dir, "pages").select(F.col("url").alias("key")), "https://", "/", max_keys=100).select("entry", "is_prefix")


@_query("""SELECT entry, is_prefix FROM (SELECT DISTINCT url AS entry, FALSE AS is_prefix FROM pages WHERE starts_with(url, 'https://') AND url > 'https://n') ORDER BY entry LIMIT 25""")
def list_after(spark, sf_dir):
    """LST2, LST5: keyset page after a token."""
    return list_page(table(spark, sf_dir, "pages").select(F.col("url").alias("key")), "https://", None, max_keys=25, after="https://n").select("entry", "is_prefix")


@_query("""SELECT lang, count(*) AS objects, CAST(sum(n) AS BIGINT) AS logical, CAST(sum((n + 8119) // 8120) AS BIGINT) AS chunk_rows, CAST(sum(n + 40 * ((n + 8119) // 8120)) AS BIGINT) AS physical
FROM (SELECT lang, octet_length(encode(text)) AS n FROM documents) GROUP BY lang""")
def storage_summary(spark, sf_dir):
    """LST9, AG14: logical and physical size."""
    n = F.octet_length("text").cast("long")
    rows = F.ceil(n / C.CHUNK)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("objects"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("logical"), F.sum(rows).cast("long").alias("chunk_rows"), F.sum(n + 40 * rows).cast("long").alias("physical"))


@_query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def latest_versions(spark, sf_dir):
    """MUT1, MUT4: the newest version of each key wins; a delete leaves none."""
    log = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
    return latest(log, ["user_id"], ["event_id"]).select("user_id", "event_id", "value")


@_query("""WITH cur AS (SELECT key, etag FROM (SELECT user_id AS key, event_id AS etag, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 2 = 0) WHERE r = 1 AND event_type <> 'error'),
q AS (SELECT x.event_id, x.user_id AS key, x.event_id % 3 AS mode, cur.etag, CASE WHEN x.event_id % 4 = 1 THEN cur.etag ELSE x.event_id END AS want FROM events x LEFT JOIN cur ON x.user_id = cur.key WHERE x.event_id % 2 <> 0)
SELECT event_id, key, CASE WHEN mode = 1 AND etag IS NOT NULL THEN 412 WHEN mode = 2 AND (etag IS NULL OR etag <> want) THEN 412 ELSE 200 END AS status FROM q""")
def conditional_writes(spark, sf_dir):
    """MUT2: if-absent and if-match conditions over every event: even ids make each key's state (an error deletes it), every other event is a request."""
    e = table(spark, sf_dir, "events")
    log = e.where("event_id % 2 = 0").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
    cur = latest(log, ["user_id"], ["event_id"]).select(F.col("user_id").alias("key"), F.col("event_id").alias("etag"))
    asked = e.where("event_id % 2 <> 0").select("event_id", F.col("user_id").alias("key"))
    mode = F.col("event_id") % 3
    want = asked.join(cur, "key", "left").select("event_id", "key", F.when(mode == 1, "absent").when(mode == 2, "match").alias("condition"), F.when(F.col("event_id") % 4 == 1, F.col("etag")).otherwise(F.col("event_id")).alias("want"))
    return conditional_puts(want, cur).select("event_id", "key", "status")


@_query("""WITH rec AS (SELECT conv_id, turn, md5(text) AS tag FROM conversations), lst AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN 'x' ELSE tag END AS tag FROM rec WHERE NOT (conv_id % 5 = 1 AND turn = 1))
SELECT coalesce(rec.conv_id, lst.conv_id) AS conv_id, bool_and(rec.tag IS NOT NULL AND lst.tag IS NOT NULL AND rec.tag = lst.tag) AS ok FROM rec FULL JOIN lst ON rec.conv_id = lst.conv_id AND rec.turn = lst.turn GROUP BY 1""")
def completed_uploads(spark, sf_dir):
    """MUT11, SO2: the listed parts must equal the recorded ones."""
    rec = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("tag"))
    lst = rec.where("not (conv_id % 5 = 1 and turn = 1)").withColumn("tag", F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), "x").otherwise(F.col("tag")))
    return complete_check(rec, lst, ["conv_id"], "turn", "tag")


@_query("""WITH u AS (SELECT conv_id, count(*) AS n, min(conv_id * 13 % 50) AS age FROM conversations GROUP BY conv_id), o AS (SELECT *, row_number() OVER (ORDER BY age DESC, conv_id) AS i, sum(n) OVER (ORDER BY age DESC, conv_id) AS used FROM u WHERE age > 24)
SELECT conv_id, n FROM o WHERE i <= 64 AND used <= 100""")
def bounded_expiry(spark, sf_dir):
    """MUT13, SR6: the uploads that go wholly in one run, oldest first, within a row budget."""
    u = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("age", F.col("conv_id") * 13 % 50)
    return expiry_budget(u.where("age > 24"), [F.desc("age"), F.asc("conv_id")], "n", rows=100, visits=64).select("conv_id", "n")


@_query("""WITH u AS (SELECT conv_id, count(*) AS n, min(conv_id * 13 % 50) AS age FROM conversations GROUP BY conv_id), o AS (SELECT *, row_number() OVER (ORDER BY age DESC, conv_id) AS i, sum(n) OVER (ORDER BY age DESC, conv_id) - n AS before FROM u WHERE age > 24)
SELECT conv_id, n, CAST(least(n, 100 - before) AS BIGINT) AS take FROM o WHERE i <= 64 AND before < 100""")
def bounded_expiry_rows(spark, sf_dir):
    """MUT13, SR6: the rows that one run takes of each upload, the one where the budget ends included."""
    u = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("age", F.col("conv_id") * 13 % 50)
    return expiry_takes(u.where("age > 24"), [F.desc("age"), F.asc("conv_id")], "n", rows=100, visits=64).select("conv_id", "n", "take")


@_query("SELECT count(*) AS num_hits FROM events WHERE event_type = 'error'")
def search_term(spark, sf_dir):
    """SE1, SE9."""
    return S.total(table(spark, sf_dir, "events"), S.Term("event_type", "error"))


@_query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND user_id < 40 ORDER BY ts DESC, event_id LIMIT 10")
def search_top(spark, sf_dir):
    """SE2, SE10, ST10."""
    return S.top(table(spark, sf_dir, "events"), S.Term("event_type", "error") & S.Range("user_id", lt=40), [F.desc("ts"), F.col("event_id")]).select("event_id", "ts", "user_id")


@_query("SELECT count(*) AS num_hits FROM conversations WHERE list_contains(string_split_regex(lower(text), '[^a-z0-9]+'), 'the')")
def search_text(spark, sf_dir):
    """SE3."""
    return S.total(table(spark, sf_dir, "conversations"), S.TextTerm("text", "the"))


@_query("SELECT count(*) AS num_hits FROM events WHERE json_extract_string(props, '$.k') = '7'")
def search_json(spark, sf_dir):
    """SE4, SC19."""
    return S.total(table(spark, sf_dir, "events"), S.Term("props.$.k", "7"))


@_query("SELECT event_type, count(*) AS num_hits FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 GROUP BY event_type")
def search_json_range(spark, sf_dir):
    """SE5."""
    return S.hits(table(spark, sf_dir, "events"), S.parse("props.$.k:>50")).groupBy("event_type").agg(F.count("*").alias("num_hits"))


@_query("SELECT count(*) AS num_hits FROM events")
def search_all(spark, sf_dir):
    """SE6."""
    return S.total(table(spark, sf_dir, "events"), S.parse("*"))


@_query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00' AND event_type = 'purchase'")
def search_window(spark, sf_dir):
    """SE7, SE8, SE13."""
    from datetime import datetime

    q = S.TimeWindow("ts", datetime(2024, 1, 10), datetime(2024, 1, 13)) & S.Term("event_type", "purchase")
    e = table(spark, sf_dir, "events")
    return S.hits(e, q).select("event_id", "value")


_BUCKET = "CAST(least(127, floor(log2(CAST(greatest(CAST(floor(value * 1000) AS BIGINT), 1) AS DOUBLE)) * 4)) AS INTEGER)"


@_query(f"SELECT event_type, {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    """TL2."""
    return T.histogram(table(spark, sf_dir, "events"), F.floor(F.col("value") * 1000), ["event_type"])


@_query(f"""WITH h AS (SELECT event_type, {_BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, round(pow(2.0, (min(bucket) + 1) / 4.0) / 1000, 9) AS ms FROM c WHERE cum >= ceil(total * 0.95) GROUP BY event_type""")
def latency_p95(spark, sf_dir):
    """TL3."""
    h = T.histogram(table(spark, sf_dir, "events"), F.floor(F.col("value") * 1000), ["event_type"])
    return T.bucket_percentile(h, 0.95, ["event_type"]).withColumn("ms", F.round("ms", 9))


@_query("""SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p_floor, list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p_index,
  list_sort(list(value))[CAST(ceil(95 * count(*) / 100.0) AS BIGINT)] AS p_ceil, round(avg(CASE WHEN value < 20 THEN 100.0 ELSE 0.0 END), 1) AS below_20 FROM events GROUP BY event_type""")
def percentiles(spark, sf_dir):
    """TL4-TL6, TL9: the three exact definitions, and the share below a bound."""
    e = table(spark, sf_dir, "events")
    at = T.exact_percentiles(e, "value", ["event_type"], {"p_floor": (T.rank_floor, 0.95), "p_index": (T.rank_index, 0.95), "p_ceil": (T.rank_ceil, 0.95)})
    below = e.groupBy("event_type").agg(T.share_below(F.col("value"), 20).alias("below_20"))
    return at.join(below, F.equal_null(at["event_type"], below["event_type"])).select(at["event_type"], "p_floor", "p_index", "p_ceil", "below_20")


@_query("""WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS active_s, round(avg(epoch_us(ts) - epoch_us(prev)) / 1e6, 3) AS mean_gap_s, round(epoch_us(min(ts)) / 1e6, 3) AS first_epoch,
  lpad(CAST(user_id AS VARCHAR), 12, '0') AS label, printf('%05.1f h', (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600e6) AS span FROM g GROUP BY user_id""")
def activity_gaps(spark, sf_dir):
    """SC7, SC8, SC16, AG12: timestamp differences as intervals and their average, epochs as doubles, padded and formatted labels."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    gaps = e.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    per_user = gaps.groupBy("user_id").agg(TM.seconds(F.max("ts") - F.min("ts")).alias("active"), TM.seconds(F.avg("gap")).alias("gap"), TM.epoch(F.min("ts")).alias("first"))
    return per_user.select(
        "user_id", F.round("active", 3).alias("active_s"), F.round("gap", 3).alias("mean_gap_s"), F.round("first", 3).alias("first_epoch"),
        F.lpad(F.col("user_id").cast("string"), 12, "0").alias("label"), F.format_string("%05.1f h", F.col("active") / 3600).alias("span"))


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS docs FROM {t}" for t in sorted(t for t in TABLES if "o" in t)))
def index_counts(spark, sf_dir):
    """SE12: the tables whose names match a pattern, with their row counts."""
    return S.indices(spark, sf_dir, "*o*")


_KEY = "lang || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')"


@_query(f"""WITH d AS (SELECT {_KEY} AS key, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL), o AS (SELECT key, CASE WHEN doc_id % 3 = 0 THEN reverse(key) ELSE text END AS body FROM d),
gone AS (SELECT key FROM o WHERE starts_with(key, 'de/') ORDER BY key LIMIT 1000), c AS (SELECT turn, coalesce(text, '') AS text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)),
m AS (SELECT 'upload' AS key, string_agg(text, '' ORDER BY turn) AS body, sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) AS etag FROM c)
SELECT key, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha256(body) AS etag, sha256(body) AS sha FROM o WHERE key NOT IN (SELECT key FROM gone)
UNION ALL SELECT key, CAST(octet_length(encode(body)) AS BIGINT), etag, sha256(body) FROM m""")
def store_read_back(spark, sf_dir):
    """SRC9, SRC10, SRC16, MUT1, MUT4-MUT12, LST2, LST6, API: a scratch store takes all documents, overwrites a third, deletes
    the first listed page of a prefix (1000 keys are a page), completes an upload, drops its garbage, and is read back whole."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and lang is not null")
    key = F.concat_ws("/", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    d = d.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    with scratch(spark, "store") as root:
        store = ObjectStore(spark, root)
        for bucket in ("docs", "empty"):
            store.create_bucket(bucket)
        store.put_many("docs", d.select("key", "data"))
        store.put_many("docs", d.where("doc_id % 3 = 0").select("key", F.reverse("key").cast("binary").alias("data")))
        page = store.list("docs", "de/")
        if page.keys:
            store.delete_many("docs", [m.key for m in page.keys])
        conv = table(spark, sf_dir, "conversations")
        first = conv.agg(F.min("conv_id")).first()[0]
        upload, tags = store.create_upload("docs", "upload"), []
        for r in conv.where(F.col("conv_id") == first).select("turn", F.coalesce("text", F.lit("")).alias("text")).orderBy("turn").collect():  # one upload's parts
            tags.append((r.turn + 1, store.upload_part(upload, "docs", "upload", r.turn + 1, r.text.encode())))
        store.complete_upload(upload, "docs", "upload", tags)
        store.delete_bucket("empty")
        store.vacuum()
        if store.list_buckets() != ["docs"] or store.stranded().count():
            raise StoreError("the store kept what was deleted")
        return kept(store.bodies("docs").select("key", "size", "etag", F.sha2("data", 256).alias("sha")))


@_query("""SELECT span, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT octet_length(encode(html)) * 400 AS size,
  CASE WHEN octet_length(encode(html)) * 400 < 65536 THEN '<64K' WHEN octet_length(encode(html)) * 400 < 524288 THEN '<512K' WHEN octet_length(encode(html)) * 400 < 2097152 THEN '<2M' WHEN octet_length(encode(html)) * 400 < 8388608 THEN '<8M' ELSE '>=8M' END AS span FROM pages) GROUP BY span""")
def span_histogram(spark, sf_dir):
    """TL1."""
    size = F.octet_length("html") * 400
    return table(spark, sf_dir, "pages").groupBy(T.span_class(size).alias("span")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


@_query("""SELECT CASE WHEN event_id * 1000 <= 8388608 THEN 0 ELSE 1 END AS class, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS ttfb_us, CAST(sum(user_id + event_id) AS BIGINT) AS total_us, CAST(sum(event_id * 1000) AS BIGINT) AS bytes,
  round(sum(event_id * 1000) / count(*) * count(*) / 1048576 / 3.5, 6) AS mib_s, round(count(*) / 3.5, 6) AS req_s FROM events GROUP BY 1""")
def read_classes(spark, sf_dir):
    """TL7, TL8."""
    e = table(spark, sf_dir, "events")
    c = T.class_counters(e, F.col("event_id") * 1000, F.col("user_id"), F.col("user_id") + F.col("event_id"))
    t = T.throughput(F.col("n"), F.col("bytes") / F.col("n"), F.lit(3.5))
    return c.withColumn("t", t).select("class", "n", "ttfb_us", "total_us", "bytes", F.round("t.mib_s", 6).alias("mib_s"), F.round("t.req_s", 6).alias("req_s"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
