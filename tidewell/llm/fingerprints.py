"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest of a text's distinct 5-word shingle hashes (48
bits each). Sketches of parts merge to the sketch of the whole. Below the
smaller of two sketches' largest values both are complete, so the share of
common values there estimates resemblance, and the share of one's values that
the other has, containment; k - 1 over the k-th smallest value (as a fraction)
estimates the number of distinct shingles. A sketch of fewer than k values is the whole
set, and all estimates from it are exact up to hash collisions.

As text, a sketch is the base64 of its values, ascending, six bytes each.

Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer than five words are one shingle.

``with_next`` walks a table in descending id order, each row beside the next,
without a window over all rows: ids are cut into ranges by quantiles, a range's
rows are sorted and streamed, and each range gets a copy of the row that
follows it. The text is shuffled once.

Defined cases: null text is empty, its sketch is empty; two empty sketches have
likeness 1, an empty and another 0; null ids come last; rows with one id are
ordered by their text's hash; a table of one row has itself as next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textkit import SPACED, WordHasher, distinct, shingles, slices

K, BITS = 128, 48
_NONE = -(1 << 63)


def sketches(texts: pa.Array, hasher: WordHasher, k: int = K) -> list[np.ndarray]:
    """The sketch of each text."""
    out = []
    for _, _, buf, offsets in slices(texts):
        hashes, _, _, first = hasher.words(buf, offsets)
        values, at = shingles(hashes, first)
        values >>= np.uint64(64 - BITS)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = values[a:b]
            if b - a > 4 * k:  # repeats may leave fewer than k of these, then all are sorted
                low = np.unique(np.partition(own, 2 * k)[: 2 * k])
                own = low[:k] if len(low) >= k else np.unique(own)[:k]
            else:
                own = np.unique(own)[:k]
            out.append(own)
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the parts' sets."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Values of a, of b and of both up to where both sketches are complete."""
    top = min(int(x[-1]) if len(x) >= k else 1 << BITS for x in (a, b))
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    na, nb, nc = (int(np.searchsorted(x, np.uint64(top), "right")) for x in (a, b, twice))
    return na, nb, nc


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the two sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    na, nb, nc = _common(a, b, k)
    return nc / (na + nb - nc)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that is in b's."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    na, _, nc = _common(a, b, k)
    return nc / na if na else 0.0


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[-1]) + 1) / 2.0**BITS)


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, n_distinct) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACED)
        for batch in batches:
            found = sketches(batch.column("text"), hasher, k)
            yield pa.record_batch({"id": batch.column("id"), "fingerprint": pa.array([encode(x) for x in found], pa.string()), "n_distinct": pa.array([distinct_count(x, k) for x in found], pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fingerprint string, n_distinct double").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_column(rows: DataFrame, n_ranges: int):
    """A column over ``o`` with the row's range, descending ids: quantile edges, found through a grid over the ids.

    Edges and grid have ``n_ranges`` and four times as many entries. None for an empty table.
    """
    low, high, edges = rows.agg(F.min("o"), F.max("o"), F.percentile_approx("o", [i / n_ranges for i in range(1, n_ranges)], 100 * n_ranges)).first()
    if low is None:
        return None
    edges = sorted(set(edges or ()))
    width = (high - low) // (4 * n_ranges) + 1
    cells = [[] for _ in range((high - low) // width + 1)]
    for e in edges:
        cells[(e - low) // width].append(e)
    before = np.concatenate(([0], np.cumsum([len(c) for c in cells]))).tolist()
    cell = F.floor((F.col("o") - F.lit(low)) / F.lit(width)).cast("int") if high - low < 1 << 52 else F.expr(f"cast((cast(o as decimal(20)) - {low}) div {width} as int)")
    if edges:
        starts, sizes = F.lit(before), F.lit([len(c) for c in cells])
        inside = F.slice(F.lit(edges), F.get(starts, cell) + 1, F.get(sizes, cell))
        under = F.get(starts, cell) + F.when(F.get(sizes, cell) == 0, 0).otherwise(F.size(F.filter(inside, lambda e: e < F.col("o"))))
    else:
        under = F.lit(0)
    return (F.lit(len(edges)) - under).cast("int")


def with_next(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    ``edited_*`` are of the text edited with the next row's, in descending id
    order (after the last: the first); ``near_*`` are resemblances of the row's fingerprint.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("o", F.coalesce("id", F.lit(_NONE))).withColumn("th", F.xxhash64("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    parts = max(8, min(20000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    where = _range_column(rows.select("o"), 4 * parts)
    if where is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.withColumn("range", where)
    # The first row of each range: as many rows as there are ranges.
    heads = sorted(rows.groupBy("range").agg(F.max(F.struct("o", "th")).alias("h")).select("range", "h.o", "h.th").collect())
    after = [(r, o, th) for (r, _, _), (_, o, th) in zip(heads, heads[1:] + heads[:1])]
    tails = rows.drop("range").join(F.broadcast(spark.createDataFrame(after, "range int, o long, th long")), ["o", "th"]).select("range", F.lit(1).alias("tail"), "id", "text", "o", "th").dropDuplicates(["range"])
    dealt = (
        rows.select("range", F.lit(0).alias("tail"), "id", "text", "o", "th").unionByName(tails)
        .repartition(parts, "range").sortWithinPartitions("range", "tail", F.desc("o"), F.desc("th"))
        .select("range", "tail", "id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(SPACED), None
        for whole in batches:
            for i in range(0, len(whole), 1000):
                batch = whole.slice(i, 1000)
                found = sketches(batch.column("text"), hasher, k)
                new = list(zip(batch.column("range").to_pylist(), batch.column("tail").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), found))
                chain = ([held] if held else []) + new
                held = chain[-1]
                at = [j for j in range(len(chain) - 1) if not chain[j][1]]  # a range's last row is the copy of what follows
                texts = [edited(chain[j][3], chain[j + 1][3]) for j in at]
                if not at:
                    continue
                others = sketches(pa.array(texts, pa.large_string()), hasher, k)
                own, nexts = [chain[j][4] for j in at], [chain[j + 1][4] for j in at]
                yield pa.record_batch([
                    pa.array([chain[j][2] for j in at], pa.int64()), pa.array([len(chain[j][3]) for j in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array([encode(x) for x in own]), pa.array([encode(x) for x in others]),
                    pa.array([resemblance(x, y, k) for x, y in zip(own, others)], pa.float64()), pa.array([resemblance(x, y, k) for x, y in zip(own, nexts)], pa.float64()),
                ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
