"""Vectorised text work for Arrow batches: bytes in, words and hashes out.

Texts are handled as one byte buffer with offsets, in slices of about a
megabyte (a longer text is a slice of its own), so memory follows the longest
text, not the batch. A word's hash is a difference of prefix sums of
byte values times powers of an odd number, modulo 2^64: no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or that with underscores in front, such that no column has it (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish = f"_{wish}"
    return wish


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers of a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MUL) + np.uint64(seed))


def byte_table(members: bytes | None = None, seps: bytes | None = None) -> np.ndarray:
    """Boolean table over bytes: those in ``members``, or all but ``seps``."""
    t = np.zeros(256, bool) if members is not None else np.ones(256, bool)
    t[np.frombuffer(members if members is not None else seps, np.uint8)] = members is not None
    return t


#: Words of the form [^\x20\x09-\x0D]+
SPACED = byte_table(seps=b" \t\n\x0b\x0c\r")
#: Words of the form [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased: a-z, 0-9 and all beyond ASCII.
ALNUM = byte_table(members=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


class WordHasher:
    """Hashes of lower-cased (A-Z) words of whole texts."""

    def __init__(self, table: np.ndarray, seed: int = 1):
        lower = np.arange(256)
        lower[65:91] += 32
        self.table = table
        self.values = np.where(table, stream(seed, 256)[lower], np.uint64(0))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SLICE_BYTES + (1 << 16))
            p = np.full(size, _MUL, np.uint64)
            q = np.full(size, pow(_MUL, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)

    def words(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word, bytes from the buffer's start, and per text the index of its first word."""
        n = len(buf)
        if n == 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
        self._grow(n + 1)
        inside = self.table[buf]
        edge = np.empty(n, bool)
        edge[0] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        edge[offsets[:-1][offsets[:-1] < n]] = True
        cuts = np.flatnonzero(edge)
        ends = np.append(cuts[1:], n)
        word = inside[cuts]
        starts, ends = cuts[word], ends[word]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[buf] * self.powers[:n], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * self.inverse[starts])
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, in order, and per text the index of its first.

    A text with fewer words (but some) has one shingle: its whole sequence.
    """
    factors = stream(seed, k) | np.uint64(1)
    n_words = np.diff(first)
    full = n_words >= k
    n_each = np.where(full, n_words - k + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n_each)))
    out = np.empty(at[-1], np.uint64)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            rolled += hashes[j : j + len(rolled)] * factors[j]
        rolled = mix64(rolled)
        # Positions in ``rolled`` of the shingles of full texts: a shift per text.
        src = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n_each)
        keep = np.repeat(full, n_each)
        out[keep] = rolled[src[keep]]
    for t in np.flatnonzero(~full & (n_words > 0)):
        own = hashes[first[t] : first[t + 1]]
        out[at[t]] = mix64((own * factors[: len(own)]).sum(keepdims=True) + stream(seed + 1, k)[len(own) - 1 : len(own)])[0]
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted without repeats, and the new segment starts."""
    values = values.copy()
    for a, b in zip(at[:-1], at[1:]):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        keep[at[:-1][at[:-1] < len(values)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[at]
