"""Packing by cutting-stock column generation.

Documents are tokenised and cut into full sequences and a remainder. Pieces are
counted by length class (``UNIT`` tokens wide), and the histogram alone goes to
the driver: a linear program over patterns (how many pieces of each class share
a sequence) whose columns are priced by a knapsack dynamic program. The rounded
pattern counts leave a bounded rest, which is packed first-fit decreasing. Every
piece has a rank within its class, and ranks are mapped to pattern slots: a join
with a table as small as the solution. Histogram, program and solution have a
size given by the number of classes, whatever the input.

Ranks need no window over a class (one may hold a third of all pieces): each
class is dealt into salts, ranked inside, and the sizes of the salts before are
added.

Tokens: this tokenizer drops white space, never joins across it and lower-cases,
so a text's ids are its words' ids in order. Words are split as bytes, A-Z
lower-cased, and their ids kept in a bounded cache per worker; a word that ends in
punctuation after an ASCII letter is two words, as the tokenizer itself splits
there. Other letters may normalise to one with a combining mark, which goes with
the punctuation, so those words are encoded whole. Texts with the opening of a
special token, which is matched before lower-casing, keep their case.

Defined cases: null or empty text is the end token alone; null ids are kept;
repeated rows are packed each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.workdir import materialise

UNIT = 8
PER_SALT, MOST_SALTS = 1_000, 4096
CACHE_WORDS = 1_000_000
_TAIL = b".,!?;:#$%&*"


class _Words(dict):
    """Ids of words as little-endian 32-bit bytes, from the tokenizer when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_TAIL)
        if stem and len(stem) < len(word) and b"<|" not in word and b"a" <= stem[-1:] <= b"z":
            ids = self[stem] + self[word[len(stem) :]]
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids_of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def _words_of(path: str) -> _Words:
    """The cache of this worker process, which lives on between tasks."""
    store = sys.modules.setdefault("_tidewell_words", types.ModuleType("_tidewell_words"))
    if getattr(store, "path", None) != path:
        store.path, store.words = path, _Words(path)
    return store.words


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): full sequences first, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(tokenizer)
        last, size = np.array([end], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch, rows = whole.slice(i, 500), []
                for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    ids = words.ids_of(text or b"") + last
                    rows += [(doc, at // 4, min(size, len(ids) - at) // 4, zlib.crc32(ids[at : at + size]), len(ids) // 4) for at in range(0, len(ids), size)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable pattern of classes 1..m (class c takes c units) in m units, and its counts."""
    m = len(prices)
    best, took = np.zeros(m + 1), np.zeros(m + 1, np.int64)
    for room in range(1, m + 1):
        value = prices[:room] + best[room - 1 :: -1][:room]
        c = int(value.argmax())
        best[room], took[room] = max(value[c], best[room - 1]), c + 1 if value[c] > best[room - 1] else 0
    counts, room = np.zeros(m, np.int64), m
    while room:
        counts[took[room] - 1] += 1 if took[room] else 0
        room -= max(1, took[room])
    return float(best[m]), counts


def fractional_patterns(demand: np.ndarray, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Column generation: patterns with their fractional uses, covering ``demand`` (pieces of class c at index c - 1).

    Revised simplex with an explicit inverse. Starts from one class a pattern;
    enters the pattern that the knapsack prices best, or a surplus column where
    a price is negative; ends when none improves.
    """
    m = len(demand)
    columns = [np.bincount([c - 1], [m // c], m) for c in range(1, m + 1)]
    costs = np.ones(m)
    inverse = np.diag([1.0 / (m // c) for c in range(1, m + 1)])
    uses = inverse @ demand
    for _ in range(rounds):
        prices = costs @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            column, cost = -np.bincount([low], minlength=m).astype(float), 0.0
        else:
            value, counts = _knapsack(np.maximum(prices, 0))
            if value <= 1 + 1e-7:
                break
            column, cost = counts.astype(float), 1.0
        d = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(uses, d, out=ratio, where=d > 1e-9)
        out = int(ratio.argmin())
        step = ratio[out]
        uses = uses - step * d
        uses[out] = step
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        columns[out], costs[out] = column, cost
    return [(c.astype(np.int64), u) for c, k, u in zip(columns, costs, uses) if k and u > 1e-9]


def solve(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and how many sequences use each; they hold at least ``demand``.

    The rest after rounding down, fewer pieces than patterns times a pattern's
    pieces, is packed first-fit decreasing, one pattern a sequence.
    """
    chosen = [(c, int(u + 1e-9)) for c, u in fractional_patterns(demand.astype(float)) if u >= 1 - 1e-9] if demand.any() else []
    left = demand - sum((c * u for c, u in chosen), np.zeros(len(demand), np.int64))
    m = len(demand)
    rooms: list[int] = []
    bins: list[np.ndarray] = []
    for c in range(m, 0, -1):
        for _ in range(max(0, int(left[c - 1]))):
            fit = next((b for b, r in enumerate(rooms) if r >= c), None)
            if fit is None:
                rooms.append(m)
                bins.append(np.zeros(m, np.int64))
                fit = len(bins) - 1
            rooms[fit] -= c
            bins[fit][c - 1] += 1
    return chosen + [(b, 1) for b in bins]


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, end rank, pieces a sequence, first sequence)."""
    rows, sequence, taken = [], 0, {}
    for counts, uses in patterns:
        for c in np.flatnonzero(counts > 0).tolist():
            at = taken.get(c, 0)
            taken[c] = at + int(counts[c]) * uses
            rows.append((c + 1, at, taken[c], int(counts[c]), sequence))
        sequence += uses
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to rows (doc_id, start, length, ...) that are stored."""
    spark, m = pieces.sparkSession, capacity // UNIT
    size = F.ceil(F.col("length") / UNIT).cast("int")
    n = pieces.count()
    if not n:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    salted = pieces.withColumn("class", size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(min(n // PER_SALT + 1, MOST_SALTS))).cast("int"))
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("class")
    before = counts.select("class", "salt", (F.sum("n").over(by_class.orderBy("salt")) - F.col("n")).alias("before"))
    demand = np.zeros(m, np.int64)
    for c, k in counts.groupBy("class").agg(F.sum("n")).collect():  # at most as many rows as classes
        demand[c - 1] = k
    table = spark.createDataFrame(slots(solve(demand)), "class int, lo long, hi long, each long, first long")
    inner = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "length", "ids_crc32")
    placed = (
        salted.withColumn("r", F.row_number().over(inner)).join(before, ["class", "salt"])
        .withColumn("rank", F.col("r") - 1 + F.col("before"))
        .join(F.broadcast(table), "class").where("rank >= lo and rank < hi")
        .withColumn("sequence_id", F.expr("first + (rank - lo) div each"))
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    return placed.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, **options) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece."""
    return pack_pieces(materialise(token_pieces(docs, tokenizer, capacity, **options), "pieces"), capacity)
