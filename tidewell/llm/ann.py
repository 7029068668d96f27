"""Approximate nearest neighbours by collision-counting hashing.

A block of vectors keeps one sorted array per random direction (the directions
come from rotations, so they don't repeat each other), as the bit sets of the rows
before each of its edges, which cut it into equal parts. A query takes a
window around its own projection in each array (query-centred and rounded out to edges, so no bucket
edge separates it from a neighbour), the difference of two bit sets; widening all windows by virtual rehashing
reuses the same sets, and collisions are counted 64 rows at a time. A vector that falls into the windows of at least
``threshold`` of the projections is a candidate, candidates are verified by the exact
inner product, and windows widen until enough candidates are found or all
vectors of the block are in.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2) with M
the largest norm (0 for queries, which are scaled to M), so the nearest have the largest product.

Blocks: vectors are dealt by hash of their id into blocks of about
``BLOCK`` rows, queries into blocks of ``QUERY_BLOCK``, so that up to that many
queries a vector is shipped and indexed once; each pair of blocks is one group, and each returns at most k rows a query. All rows are indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; a vector never finds rows of its own id; equal
products go by the smaller id; with fewer than k candidates all are returned;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 16384, 16384
#: Queries that are counted at once, and the parts of a sorted array.
BATCH, PARTS = 256, 64
#: Projections, the share of them in whose windows a candidate is, the candidates beyond k at which windows stop to widen
#: (rows, share of the block), the share of an array in the first windows, and the factor by which they widen.
PROJECTIONS, THRESHOLD, EXTRA, SHARE, START, STEP = 128, 0.85, 100, 0.025, 0.8, 1.04


def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` unit directions as columns, from random rotations: those of one rotation are orthogonal, so together they miss no part of a difference."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(turns, axis=1)[:, :count]


class Counters:
    """Sums of bit sets, place by place, held as one bit set a binary digit; three sets of one digit become a sum and a carry."""

    def __init__(self):
        self.digits: list[list[np.ndarray]] = []
        self.free: list[np.ndarray] = []

    def buffer(self, like: np.ndarray) -> np.ndarray:
        return self.free.pop() if self.free else np.empty_like(like)

    def add(self, bits: np.ndarray, digit: int = 0) -> None:
        """Adds ``bits``, which are taken over."""
        while True:
            if digit == len(self.digits):
                self.digits.append([])
            held = self.digits[digit]
            held.append(bits)
            if len(held) < 3:
                return
            bits = self._carry(held, digit)
            digit += 1

    def _carry(self, held: list[np.ndarray], digit: int) -> np.ndarray:
        a, b, *c = held
        total = np.bitwise_xor(a, b, out=self.buffer(a))
        np.bitwise_and(a, b, out=a)
        if c:
            np.bitwise_and(total, c[0], out=b)
            np.bitwise_or(a, b, out=a)
            np.bitwise_xor(total, c[0], out=total)
        self.free += [b, *c]
        self.digits[digit] = [total]
        return a

    def at_least(self, least: int) -> np.ndarray:
        """The places whose sum is ``least`` or more."""
        digit = 0
        while digit < len(self.digits):
            if len(self.digits[digit]) == 2:
                self.add(self._carry(self.digits[digit], digit), digit + 1)
            digit += 1
        sums = [d[0] for d in self.digits if d]
        if least >> len(sums):
            return np.zeros_like(sums[0])
        more, same = np.zeros_like(sums[0]), np.full_like(sums[0], np.iinfo(np.uint64).max)
        for digit in reversed(range(len(sums))):
            if least >> digit & 1:
                same &= sums[digit]
            else:
                more |= same & sums[digit]
                same &= ~sums[digit]
        return more | same


class SortedProjections:
    """One block's index: for each projection the edges of PARTS equal parts of its sorted array, and per edge the bit set of the rows before it."""

    def __init__(self, vectors: np.ndarray, largest: float, seed: int = 0, projections: int = PROJECTIONS):
        n, dim = vectors.shape
        self.vectors, self.m, self.largest = vectors, projections, largest
        self.a = _directions(dim + 1, projections, seed)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        height = np.sqrt(np.maximum(largest * largest - norms, 0))
        at = (vectors @ self.a[:-1] + np.outer(height, self.a[-1])).T.copy()
        ends = np.arange(PARTS + 1) * n // PARTS
        self.edges = np.empty((projections, PARTS - 1))
        self.before = np.zeros((projections, PARTS + 1, -(-n // 64) * 8), np.uint8)
        rank, reach = np.empty(n, np.int32), []
        for p, values in enumerate(at):
            order = np.argsort(values, kind="stable")
            rank[order] = np.arange(n, dtype=np.int32)
            self.edges[p] = values[order[ends[1:-1]]]
            self.before[p, :, : -(-n // 8)] = np.packbits(rank < ends[:, None].astype(np.int32), axis=1, bitorder="little")
            reach.append(values[order[int((n - 1) * (1 + START) / 2)]] - values[order[int((n - 1) * (1 - START) / 2)]])
        self.before = self.before.view(np.uint64)
        # A start from which few rounds are left: half of what holds START of an array around its middle.
        self.first_width = max(1e-9, float(np.median(reach)) / 2)

    def _collide(self, centres: np.ndarray, widths: np.ndarray, words: int) -> np.ndarray:
        """Bit sets, one a query, of the rows of the first ``words`` words in the windows of THRESHOLD of the projections; windows end at edges of parts."""
        counters, shape = Counters(), np.empty((len(centres), words), np.uint64)
        low, high = centres - widths[:, None], centres + widths[:, None]
        for p, (edges, before) in enumerate(zip(self.edges, self.before)):
            window, left = counters.buffer(shape), counters.buffer(shape)
            np.take(before[:, :words], edges.searchsorted(high[:, p], "right") + 1, axis=0, out=window, mode="clip")
            np.take(before[:, :words], edges.searchsorted(low[:, p], "left"), axis=0, out=left, mode="clip")
            np.bitwise_xor(window, left, out=window)
            counters.free.append(left)
            counters.add(window)
        return counters.at_least(int(np.ceil(THRESHOLD * self.m)))

    def candidates(self, queries: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that collide with it in at least THRESHOLD of the projections, ``wanted`` or more of them.

        All queries are counted at once; a query leaves when it has enough. Windows widen over
        an eighth of the rows first, which tells about where to start over all of them.
        """
        n, words = len(self.vectors), self.before.shape[2]
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        active = np.flatnonzero(wanted < n)
        if not len(active):
            return out
        # The order of inner products doesn't depend on the query's length; at the largest norm distances differ most.
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        centres = (queries * (self.largest / lengths)[:, None]) @ self.a[:-1]
        widths = np.full(len(queries), self.first_width)
        for part in (words // 8, words) if words >= 64 else (words,):
            share, going = part / words if part < words else 1.0, active
            while len(going):
                bits = self._collide(centres[going], widths[going], part)
                enough = np.bitwise_count(bits).sum(axis=1, dtype=np.int64) >= wanted[going] * share
                if part == words:
                    for i in np.flatnonzero(enough).tolist():
                        out[going[i]] = np.flatnonzero(np.unpackbits(bits[i].view(np.uint8), count=n, bitorder="little"))
                going = going[~enough]
                widths[going] *= STEP
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, products) of each query's best k candidates that don't have its id."""
        own = np.array([np.count_nonzero(ids == q) for q in query_ids], np.int64)
        answers = []
        for query, q, rows in zip(queries, query_ids, self.candidates(queries, k + EXTRA + int(SHARE * len(ids)) + own)):
            rows = rows[ids[rows] != q]
            scores = (self.vectors[rows] * query).sum(axis=1)
            if len(rows) > 4 * k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= cut
                rows, scores = rows[keep], scores[keep]
            best = np.lexsort((ids[rows], -scores))[:k]
            answers.append((ids[rows][best], scores[best]))
        return answers


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``vectors`` where ``queries`` holds."""
    v = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where("id is not null")
    n, n_queries, largest = v.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = v.select("id", "v", F.lit(False).alias("is_q"), block(blocks, 1).alias("b"), every(query_blocks).alias("qb"))
    asked = v.where("q").select("id", "v", F.lit(True).alias("is_q"), block(query_blocks, 2).alias("qb"), every(blocks).alias("b")).select("id", "v", "is_q", "b", "qb")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_q = np.asarray(group.column("is_q"))
        ids = np.asarray(group.column("id"))
        lists = group.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        out = ([], [], [])
        flat, at = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(sizes)))
        for dim in np.unique(sizes[is_q]).tolist():  # vectors of another length cannot be compared
            pick = lambda rows: np.stack([flat[at[r] : at[r] + dim] for r in rows]) if len(rows) else np.zeros((0, dim))  # noqa: E731, B023
            rows, asked_rows = np.flatnonzero(~is_q & (sizes == dim)), np.flatnonzero(is_q & (sizes == dim))
            if not len(rows):
                continue
            index, own_ids = SortedProjections(pick(rows), float(largest or 0)), ids[rows]
            for i in range(0, len(asked_rows), BATCH):
                batch = asked_rows[i : i + BATCH]
                for r, (found, scores) in zip(batch.tolist(), index.search(pick(batch), ids[batch], own_ids, k)):
                    for part, x in zip(out, (np.full(len(found), ids[r]), found, scores)):
                        part.append(x)
        full = [np.concatenate(p) if p else np.zeros(0) for p in out]
        return pa.table({"query_id": pa.array(full[0].astype(np.int64)), "vec_id": pa.array(full[1].astype(np.int64)), "score": pa.array(full[2].astype(np.float64))})

    found = data.unionByName(asked).groupBy("b", "qb").applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
