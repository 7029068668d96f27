"""A byte-addressed object store as tables below one root.

Layout::

    <root>/layout.json              version marker; any other version is refused
    <root>/log/<version>.json       one file a commit, one action a line
    <root>/batches/batch=<id>/      actions of bulk commits, as Parquet
    <root>/chunks/folder=<n>/gen=<g>/  chunk rows (file_id, no, chunk), 32 folders by file id, by generation
    <root>/vacuums/<g>.json         one file a vacuum: for each folder the generation up to which its rows are gone

A commit is the exclusive creation of the next log file: whoever loses the race
re-reads the state and checks its condition again, so conditional writes have
one winner. Chunks are written before the commit and belong to no object until
it; a failed write leaves files that no object names, which ``vacuum`` removes.
State is the newest action of each key, so readers see a snapshot. A vacuum writes
what it keeps as the next generation and switches to it by the exclusive creation
of its file; a generation without one is invisible, so a crash loses nothing.

Ranged reads resolve metadata, plan chunk numbers on the driver and filter the
chunk table by folder, file and number: folders are pruned, and file and number
reach the Parquet scan.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import chunking as C
from tidewell.operators.listing import MAX_KEYS, list_page
from tidewell.operators.versions import expiry_takes

LAYOUT_VERSION = 4
_ACTION = """v long, i long, kind string, op string, bucket string, key string, file_id long, size long, etag string, created_at double,
parts array<long>, part_ends array<long>, upload_id string, part_no int, batch string"""
_CHUNKS = "file_id long, no int, chunk binary, folder int, gen int"


class StoreError(Exception):
    status = 400


class NoSuchBucket(StoreError):
    status = 404


class NoSuchKey(StoreError):
    status = 404


class NoSuchUpload(StoreError):
    status = 404


class BucketNotEmpty(StoreError):
    status = 409


class PreconditionFailed(StoreError):
    status = 412


class InvalidRange(StoreError):
    status = 416


class InvalidPart(StoreError):
    status = 400


class BadRequest(StoreError):
    status = 400


class NotSupported(StoreError):
    status = 501


@dataclass(frozen=True)
class Meta:
    bucket: str
    key: str
    file_id: int
    size: int
    etag: str
    created_at: float
    parts: tuple[int, ...] = ()
    part_ends: tuple[int, ...] = ()


@dataclass(frozen=True)
class Body:
    meta: Meta
    start: int
    end: int
    data: bytes

    @property
    def content_range(self) -> str | None:
        return f"bytes {self.start}-{self.end}/{self.meta.size}" if self.meta.size else None


@dataclass(frozen=True)
class Page:
    keys: tuple[Meta, ...]
    prefixes: tuple[str, ...]
    truncated: bool
    next_token: str | None


def _now() -> float:
    return datetime.now(timezone.utc).timestamp()


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        marker = self._path("layout.json")
        if self._fs.exists(marker):
            try:
                version = json.loads(self._read_text(marker))["version"]
            except (Py4JJavaError, ValueError, KeyError, TypeError) as e:
                raise StoreError("the store's layout marker can't be read") from e
            if version != LAYOUT_VERSION:
                raise StoreError("the store has another layout version")
        elif self._fs.exists(self._path("chunks")) or self._fs.exists(self._path("log")):
            raise StoreError("the store has data but no layout marker")
        else:
            self._create("layout.json", json.dumps({"version": LAYOUT_VERSION}))
            self._fs.mkdirs(self._path("log"))

    # -- files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read_text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file whole or not at all; False if it exists."""
        temp, target = self._path(f"tmp-{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs.create(temp, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(temp, target, none)
            return True
        except Exception:
            self._fs.delete(temp, False)
            if self._fs.exists(target):
                return False
            raise

    def version(self) -> int:
        """The newest committed version; 0 for none."""
        return max((int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path("log")) if s.getPath().getName().endswith(".json")), default=0)

    def _commit(self, make) -> int:
        """Append what ``make(state version)`` returns as the next version; checks run again after a lost race."""
        for _ in range(100):
            at = self.version()
            actions = make()
            if not actions:
                return at
            lines = "".join(json.dumps({"v": at + 1, "i": i, **a}) + "\n" for i, a in enumerate(actions))
            if self._create(f"log/{at + 1:020d}.json", lines):
                return at + 1
        raise StoreError("too many concurrent commits")

    # -- state

    def actions(self) -> DataFrame:
        """All committed actions, bulk ones included."""
        log = self.spark.read.schema(_ACTION).json(f"{self.root}/log")
        out = log.where("kind <> 'batch'")
        if not self._fs.exists(self._path("batches")):
            return out
        # A batch has the version of the commit that names it; one that none names is left out.
        named = log.where("kind = 'batch'").select("batch", "v")
        return out.unionByName(self.spark.read.schema(_ACTION).parquet(f"{self.root}/batches").drop("v").join(named, "batch"))

    def _newest(self, kind: str, keys: list[str]) -> DataFrame:
        rows = self.actions().where(F.col("kind") == kind)
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("v", "i")).alias("r")).select(*keys, "r.*").where("op = 'put'")

    def buckets(self) -> DataFrame:
        return self._newest("bucket", ["bucket"]).select(F.col("bucket").alias("name"), "created_at")

    def objects(self) -> DataFrame:
        return self._newest("object", ["bucket", "key"]).select("bucket", "key", "file_id", "size", "etag", "created_at", "parts", "part_ends")

    def uploads(self) -> DataFrame:
        return self._newest("upload", ["upload_id"]).select("upload_id", "bucket", "key", "created_at")

    def upload_parts(self) -> DataFrame:
        parts = self._newest("part", ["upload_id", "part_no"]).select("upload_id", "part_no", "file_id", "size", "etag")
        return parts.join(self.uploads().select("upload_id"), "upload_id", "left_semi")

    def chunks(self) -> DataFrame:
        if not self._fs.exists(self._path("chunks")):
            return self.spark.createDataFrame([], _CHUNKS)
        gen, gone = self._generation()
        rows = self.spark.read.schema(_CHUNKS).parquet(f"{self.root}/chunks").where(F.col("gen") <= gen)
        if gone:
            rows = rows.where(F.col("gen") > F.coalesce(F.get(F.array(*(F.lit(gone.get(i, -1)) for i in range(C.FOLDERS))), F.col("folder")), F.lit(-1)))
        return rows

    def _generation(self) -> tuple[int, dict[int, int]]:
        """The generation that writes go to, and for each folder the last one that is gone."""
        if not self._fs.exists(self._path("vacuums")):
            return 0, {}
        gen = max((int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path("vacuums")) if s.getPath().getName().endswith(".json")), default=0)
        return gen, {int(k): v for k, v in json.loads(self._read_text(self._path(f"vacuums/{gen:020d}.json"))).items()} if gen else {}

    def _has_bucket(self, bucket: str) -> None:
        if self.buckets().where(F.col("name") == bucket).isEmpty():
            raise NoSuchBucket(bucket)

    def _find(self, bucket: str, key: str) -> Meta | None:
        row = self.objects().where((F.col("bucket") == bucket) & (F.col("key") == key)).first()
        return self._meta(row) if row else None

    @staticmethod
    def _meta(r: Row) -> Meta:
        return Meta(r.bucket, r.key, r.file_id, r.size, r.etag, r.created_at, tuple(r.parts or ()), tuple(r.part_ends or ()))

    # -- buckets

    def create_bucket(self, bucket: str) -> None:
        self._commit(lambda: [] if not self.buckets().where(F.col("name") == bucket).isEmpty() else [{"kind": "bucket", "op": "put", "bucket": bucket, "created_at": _now()}])

    def head_bucket(self, bucket: str) -> bool:
        return not self.buckets().where(F.col("name") == bucket).isEmpty()

    def delete_bucket(self, bucket: str) -> None:
        def make():
            self._has_bucket(bucket)
            if not (self.objects().where(F.col("bucket") == bucket).isEmpty() and self.uploads().where(F.col("bucket") == bucket).isEmpty()):
                raise BucketNotEmpty(bucket)
            return [{"kind": "bucket", "op": "delete", "bucket": bucket}]

        self._commit(make)

    def list_buckets(self) -> list[str]:
        return [r.name for r in self.buckets().orderBy("name").collect()]

    # -- writing

    def _write_chunks(self, objects: DataFrame) -> None:
        """Append chunk rows of (file_id, data)."""
        rows = C.chunk_rows(objects).withColumn("folder", C.folder_of(F.col("file_id"))).withColumn("gen", F.lit(self._generation()[0]))
        rows.write.mode("append").partitionBy("folder", "gen").parquet(f"{self.root}/chunks")

    def _write_bytes(self, data: bytes) -> tuple[int, str]:
        file_id = uuid.uuid4().int >> 65
        if data:
            self._write_chunks(self.spark.createDataFrame([(file_id, bytearray(data))], "file_id long, data binary"))
        return file_id, hashlib.sha256(data).hexdigest()

    @staticmethod
    def _condition(if_none_match: str | None, if_match: str | None):
        if if_none_match is not None and (if_none_match != "*" or if_match is not None):
            raise BadRequest("If-None-Match takes *, and no If-Match beside it")
        tag = None
        if if_match is not None:
            found = re.fullmatch('"([0-9a-f]{64})"', if_match)
            if not found:
                raise BadRequest("If-Match takes one strong etag")
            tag = found[1]

        def check(current: Meta | None) -> None:
            if if_none_match and current or tag and (not current or current.etag != tag):
                raise PreconditionFailed

        return check

    def put(self, bucket: str, key: str, data: bytes, if_none_match: str | None = None, if_match: str | None = None) -> Meta:
        check = self._condition(if_none_match, if_match)
        self._has_bucket(bucket)
        check(self._find(bucket, key))
        file_id, etag = self._write_bytes(data)
        meta = Meta(bucket, key, file_id, len(data), etag, _now())

        def make():
            self._has_bucket(bucket)
            check(self._find(bucket, key))
            return [{"kind": "object", "op": "put", "bucket": bucket, "key": key, "file_id": file_id, "size": len(data), "etag": etag, "created_at": meta.created_at}]

        self._commit(make)
        return meta

    def put_many(self, bucket: str, objects: DataFrame) -> None:
        """Bulk put of rows (key, data): chunks and actions are written by the executors, then committed at once.

        Repeated keys: the row with the largest hash wins. ``objects`` must be deterministic.
        """
        self._has_bucket(bucket)
        batch, base = f"b{uuid.uuid4().hex}", uuid.uuid4().int >> 65
        rows = objects.select("key", F.col("data"), F.sha2("data", 256).alias("etag"))
        # The id of a file is derived from its key and content, so a retried task writes the same.
        rows = rows.withColumn("file_id", F.xxhash64(F.lit(base), "key", "etag").bitwiseAND(F.lit((1 << 63) - 1))).dropDuplicates(["key", "etag"])
        self._write_chunks(rows.select("file_id", "data"))
        put = rows.select("key", "file_id", F.octet_length("data").cast("long").alias("size"), "etag")
        full = {"i": F.col("file_id"), "kind": F.lit("object"), "op": F.lit("put"), "bucket": F.lit(bucket), "created_at": F.lit(_now())}
        schema = self.spark.createDataFrame([], _ACTION).schema
        put.withColumns(full).select(*((F.col(f.name) if f.name in put.columns or f.name in full else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("v", "batch"))).write.parquet(f"{self.root}/batches/batch={batch}")

        def make():
            self._has_bucket(bucket)
            return [{"kind": "batch", "batch": batch}]

        self._commit(make)

    def delete(self, bucket: str, key: str) -> None:
        """A missing key is no error."""
        self.delete_many(bucket, [key])

    def delete_many(self, bucket: str, keys: list[str], versioned: bool = False) -> list[str]:
        """At most 1000 keys, all checked before any goes; returns them."""
        if versioned:
            raise NotSupported("versioned or conditional deletes")
        if not keys or len(keys) > MAX_KEYS or not all(keys):
            raise BadRequest("1 to 1000 keys, none empty")

        def make():
            self._has_bucket(bucket)
            have = {r.key for r in self.objects().where((F.col("bucket") == bucket) & F.col("key").isin(keys)).select("key").collect()}
            return [{"kind": "object", "op": "delete", "bucket": bucket, "key": k} for k in dict.fromkeys(keys) if k in have]

        self._commit(make)
        return keys

    # -- reading

    def head(self, bucket: str, key: str) -> Meta:
        found = self._find(bucket, key)
        if not found:
            self._has_bucket(bucket)
            raise NoSuchKey(key)
        return found

    def read_pieces(self, meta: Meta, start: int, end: int) -> DataFrame:
        """Rows (seq, no, piece) of a byte range: chunk rows by number, trimmed.

        One scan whatever the number of parts; it meets their table, 10,000 rows at most.
        """
        ids, ends = meta.parts or (meta.file_id,), meta.part_ends or (meta.size,)
        parts = [
            (seq, file_id, base, (max(start, base) - base) // C.CHUNK, (min(end, stop - 1) - base) // C.CHUNK)
            for seq, (file_id, base, stop) in enumerate(zip(ids, (0, *ends[:-1]), ends)) if base < stop and base <= end and start < stop]
        table = self.spark.createDataFrame(parts, "seq int, file_id long, base long, lo int, hi int")
        files = [p[1] for p in parts]
        near = F.col("folder").isin(self._folders(files)) & F.col("file_id").isin(files) & F.col("no").between(min((p[3] for p in parts), default=0), max((p[4] for p in parts), default=-1))
        piece = C.sliced(F.col("chunk"), F.col("no"), F.col("base"), F.lit(start).cast("long"), F.lit(end).cast("long"))
        return self.chunks().where(near).join(F.broadcast(table), "file_id").where("no between lo and hi").select("seq", "no", piece.alias("piece"))

    def _folders(self, files: list[int]) -> list[int]:
        """The folders of some files, as ``folder_of`` gives them."""
        hashed = self._jvm.org.apache.spark.sql.catalyst.expressions.XXH64.hashLong
        return sorted({hashed(self._jvm.java.lang.Long(f), self._jvm.java.lang.Long(42)) % C.FOLDERS for f in files})

    def _range(self, bucket: str, key: str, range_header: str | None) -> tuple[Meta, int, int]:
        """Metadata and the inclusive range that is meant; (0, -1) for an empty object."""
        meta = self.head(bucket, key)
        first, last, suffix = C.range_header(range_header)
        if meta.size == 0:
            return meta, 0, -1
        start = max(meta.size - suffix, 0) if suffix >= 0 else max(first, 0)
        end = meta.size - 1 if suffix >= 0 or last < 0 else min(last, meta.size - 1)
        if start > end or start >= meta.size:
            raise InvalidRange(range_header)
        return meta, start, end

    def _pieces(self, meta: Meta, start: int, end: int) -> Iterator[bytes]:
        left = end - start + 1
        if left:
            for r in self.read_pieces(meta, start, end).orderBy("seq", "no").toLocalIterator():
                left -= len(r.piece)
                yield bytes(r.piece)
        if left:
            raise StoreError("chunk rows are missing")

    def stream(self, bucket: str, key: str, range_header: str | None = None) -> Iterator[bytes]:
        """The body in order, a chunk row at a time; the driver holds one partition of them. Raises at the end if rows were missing."""
        return self._pieces(*self._range(bucket, key, range_header))

    def get(self, bucket: str, key: str, range_header: str | None = None) -> Body:
        """The body at once. Where its rows went between lookup and read (an overwrite, then a vacuum), both are done once more."""
        for again in (True, False):
            meta, start, end = self._range(bucket, key, range_header)
            try:
                return Body(meta, start, end, b"".join(self._pieces(meta, start, end)))
            except (StoreError, Py4JJavaError):
                if not again:
                    raise
        raise AssertionError

    def bodies(self, bucket: str) -> DataFrame:
        """Rows (key, size, etag, data) of all objects, put together on the executors; raises where chunk rows are missing."""
        o = self.objects().where(F.col("bucket") == bucket).select("key", "size", "etag", C.segments(F.col("parts"), F.col("part_ends"), F.col("file_id"), F.col("size")).alias("s"))
        rows = o.select("key", "size", "etag", F.explode("s").alias("s")).select("key", "size", "etag", "s.file_id", "s.base").join(self.chunks(), "file_id")
        data = C.reassemble(rows, ["key"], ["base", "no"], "chunk", "size")
        return o.drop("s").join(data, "key", "left").withColumn("body", F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.coalesce("body", F.raise_error(F.lit("chunk rows are missing")).cast("binary")))).withColumnRenamed("body", "data")

    def list(self, bucket: str, prefix: str = "", delimiter: str | None = None, max_keys: int = MAX_KEYS, start_after: str | None = None, token: str | None = None) -> Page:
        self._has_bucket(bucket)
        n = max(0, min(max_keys, MAX_KEYS))
        objects = self.objects().where(F.col("bucket") == bucket)
        after = token if token is not None else start_after
        rows = list_page(objects.select("key"), prefix, delimiter, MAX_KEYS, after).limit(n + 1).collect() if n < MAX_KEYS else self._more(objects, prefix, delimiter, after)
        shown = rows[:n]
        metas = {m.key: m for m in map(self._meta, objects.where(F.col("key").isin([r.entry for r in shown if not r.is_prefix])).collect())} if shown else {}
        truncated = len(rows) > n and n > 0
        return Page(tuple(metas[r.entry] for r in shown if not r.is_prefix), tuple(r.entry for r in shown if r.is_prefix), truncated, shown[-1].entry if truncated else None)

    @staticmethod
    def _more(objects: DataFrame, prefix: str, delimiter: str | None, after: str | None) -> list[Row]:
        rows = list_page(objects.select("key"), prefix, delimiter, MAX_KEYS, after).collect()
        if len(rows) == MAX_KEYS:
            rows += list_page(objects.select("key"), prefix, delimiter, 1, rows[-1].entry).collect()
        return rows

    # -- multipart

    def create_upload(self, bucket: str, key: str) -> str:
        """The upload of a key; asking again returns the same id."""
        new = uuid.uuid4().hex
        out = []

        def make():
            self._has_bucket(bucket)
            old = self.uploads().where((F.col("bucket") == bucket) & (F.col("key") == key)).first()
            out[:] = [old.upload_id if old else new]
            return [] if old else [{"kind": "upload", "op": "put", "upload_id": new, "bucket": bucket, "key": key, "created_at": _now()}]

        self._commit(make)
        return out[0]

    def _upload(self, upload_id: str, bucket: str, key: str) -> None:
        if self.uploads().where((F.col("upload_id") == upload_id) & (F.col("bucket") == bucket) & (F.col("key") == key)).isEmpty():
            raise NoSuchUpload(upload_id)

    def upload_part(self, upload_id: str, bucket: str, key: str, part_no: int, data: bytes) -> str:
        """A later attempt at a part replaces the one before."""
        if not 1 <= part_no <= 10_000:
            raise BadRequest("part numbers are 1 to 10000")
        self._upload(upload_id, bucket, key)
        file_id, etag = self._write_bytes(data)

        def make():
            self._upload(upload_id, bucket, key)
            return [{"kind": "part", "op": "put", "upload_id": upload_id, "part_no": part_no, "file_id": file_id, "size": len(data), "etag": etag}]

        self._commit(make)
        return etag

    def complete_upload(self, upload_id: str, bucket: str, key: str, parts: list[tuple[int, str]]) -> Meta:
        """Publish the recorded parts as one object; no data moves.

        The listed (number, etag) pairs must be exactly the recorded ones, in any
        order. Repeated after success it returns the object that is current.
        """
        done: list[Meta] = []

        def make():
            if self.uploads().where(F.col("upload_id") == upload_id).isEmpty():
                current = self._find(bucket, key)
                if not current:
                    raise NoSuchUpload(upload_id)
                done[:] = [current]
                return []
            self._upload(upload_id, bucket, key)
            rec = self.upload_parts().where(F.col("upload_id") == upload_id).orderBy("part_no").collect()
            if not rec or not all(r.etag for r in rec) or len(parts) != len(rec) or {(p, t.strip('"')) for p, t in parts} != {(r.part_no, r.etag) for r in rec}:
                raise InvalidPart("listed and recorded parts differ")
            ends, at = [], 0
            for r in rec:
                ends.append(at := at + r.size)
            etag = hashlib.sha256(b"".join(bytes.fromhex(r.etag) for r in rec)).hexdigest()
            meta = Meta(bucket, key, rec[0].file_id, at, etag, _now(), tuple(r.file_id for r in rec), tuple(ends))
            done[:] = [meta]
            return [
                {"kind": "object", "op": "put", "bucket": bucket, "key": key, "file_id": meta.file_id, "size": at, "etag": etag, "created_at": meta.created_at, "parts": list(meta.parts), "part_ends": ends},
                {"kind": "upload", "op": "delete", "upload_id": upload_id},
            ]

        self._commit(make)
        return done[0]

    def abort_upload(self, upload_id: str, bucket: str, key: str) -> None:
        def make():
            self._upload(upload_id, bucket, key)
            return [{"kind": "upload", "op": "delete", "upload_id": upload_id}]

        self._commit(make)

    def expire_uploads(self, grace: timedelta = timedelta(hours=24), rows: int = 4096, visits: int = 64, bucket: str | None = None, now: float | None = None) -> int:
        """Drop the oldest uploads past ``grace``, within a budget of chunk rows; returns the rows that go.

        The upload where the budget ends loses parts in order, and the last part it
        reaches the rows at its end; later runs go on there. A shortened part has
        no etag, so it can't be completed, only sent again.
        """
        cut = (now if now is not None else _now()) - grace.total_seconds()
        gone = [0]

        def make():
            old = self.uploads().where((F.col("created_at") < cut) & (F.lit(bucket is None) | (F.col("bucket") == (bucket or ""))))
            parts = self.upload_parts().withColumn("n", F.ceil(F.col("size") / C.CHUNK))
            weight = parts.groupBy("upload_id").agg(F.sum("n").alias("n"))
            due = expiry_takes(old.join(weight, "upload_id", "left").fillna(0, ["n"]), [F.col("created_at"), F.col("upload_id")], "n", rows, visits).collect()
            gone[0] = int(sum(r.take for r in due))
            out = [{"kind": "upload", "op": "delete", "upload_id": r.upload_id} for r in due if r.take == r.n]
            for u in due:
                if u.take == u.n:
                    continue
                left = u.take
                for r in parts.where(F.col("upload_id") == u.upload_id).orderBy("part_no").collect():  # at most 10,000
                    if r.n <= left:
                        out.append({"kind": "part", "op": "delete", "upload_id": u.upload_id, "part_no": r.part_no})
                        left -= r.n
                        continue
                    if left:
                        out.append({"kind": "part", "op": "put", "upload_id": u.upload_id, "part_no": r.part_no, "file_id": r.file_id, "size": (r.n - left) * C.CHUNK, "etag": ""})
                    break
            return out

        self._commit(make)
        return gone[0]

    # -- upkeep

    def _live_files(self) -> DataFrame:
        """Rows (live, rows): named files, and how many of their chunk rows if expiry has shortened them."""
        o = self.objects().select(F.explode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("file_id"))).alias("live"), F.lit(None).cast("long").alias("rows"))
        return o.unionByName(self.upload_parts().select(F.col("file_id").alias("live"), F.when(F.col("etag") == "", F.ceil(F.col("size") / C.CHUNK)).alias("rows"))).distinct()

    @staticmethod
    def _is_live():
        return (F.col("file_id") == F.col("live")) & (F.col("rows").isNull() | (F.col("no") < F.col("rows")))

    def stranded(self) -> DataFrame:
        """Chunk rows that no object or open upload names."""
        return self.chunks().select("file_id", "no", "folder").join(self._live_files(), self._is_live(), "left_anti")

    def vacuum(self) -> int:
        """Rewrite the folders that hold stranded rows without them; returns how many went.

        Run it while nothing writes: rows of a write in progress look stranded.
        """
        gen, gone = self._generation()
        counts = {r.folder: r.n for r in self.stranded().groupBy("folder").agg(F.count("*").alias("n")).collect()}  # 32 folders at most
        for folder in range(C.FOLDERS):  # what a vacuum left that crashed before its switch
            self._fs.delete(self._path(f"chunks/folder={folder}/gen={gen + 1}"), True)
        if counts:
            kept = self.chunks().where(F.col("folder").isin(list(counts))).join(self._live_files(), self._is_live(), "left_semi")
            kept.withColumn("gen", F.lit(gen + 1)).repartition("folder", "file_id").write.mode("append").partitionBy("folder", "gen").parquet(f"{self.root}/chunks")
            gone = gone | dict.fromkeys(counts, gen)
            self._fs.mkdirs(self._path("vacuums"))
            if not self._create(f"vacuums/{gen + 1:020d}.json", json.dumps(gone)):
                raise StoreError("another vacuum ran")
        for folder, last in gone.items():
            path = self._path(f"chunks/folder={folder}")
            for old in self._fs.listStatus(path) if self._fs.exists(path) else ():
                name = old.getPath().getName()
                if name.startswith("gen=") and int(name[4:]) <= last:
                    self._fs.delete(old.getPath(), True)
        self.spark.catalog.clearCache()
        return sum(counts.values())

    def stat(self) -> dict[str, float]:
        """Logical and stored bytes, objects, chunk rows and the overhead in percent."""
        o = self.objects().agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical")).first()
        rows = self.chunks().agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)).alias("payload")).first()
        stored = self._fs.getContentSummary(self._path("chunks")).getLength() if self._fs.exists(self._path("chunks")) else 0
        return {"objects": o.objects, "logical": int(o.logical), "chunk_rows": rows.rows, "payload": int(rows.payload), "stored": stored, "overhead_pct": 100.0 * (stored / o.logical - 1) if o.logical else 0.0}
