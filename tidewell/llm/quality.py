"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of ``CHUNK`` bytes (each
starts ``CHUNK - OVERLAP`` after the one before; the last is padded with zero
bytes). Filters of ``WIDTH`` bytes slide over a chunk in steps of ``STEP`` and are
max-pooled to one value each; a linear layer makes the chunk's logit; the mean,
least and largest chunk logit combine to the document's probability. Every byte of every
document counts, whatever its length.

A filter over one-hot bytes is a table per byte position, so a forward pass is
table lookups and sums. The gradient of a max-pool reaches one window per
filter and chunk, so training scatters into few table entries.

Training takes a bounded sample: at most ``sample_rows`` labelled rows (lowest
hashes of the id) with texts of at most ``sample_bytes``; scoring takes all rows.

Defined cases: null or empty text scores as one chunk of padding; rows without
label or with a null label don't train; without any usable labels every score
is 0.5; repeated rows score alike; an empty table gives no rows; other columns
pass through untouched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewell.llm.textkit import free_name, slices

CHUNK, OVERLAP, WIDTH, STEP, FILTERS = 512, 64, 8, 4, 24
WINDOWS = CHUNK // STEP
_PADDED = CHUNK + WIDTH - STEP


class Model(NamedTuple):
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weight: np.ndarray  # (FILTERS,)
    combine: np.ndarray  # of the mean, least and largest chunk logit
    offset: float


def chunks_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts as rows of bytes, and per text the index of its first."""
    step = CHUNK - OVERLAP
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    first = np.concatenate(([0], np.cumsum(n)))
    local = np.arange(first[-1]) - np.repeat(first[:-1], n)
    starts = np.repeat(offsets[:-1], n) + local * step
    left = np.repeat(offsets[1:], n) - starts
    padded = np.concatenate((buf, np.zeros(_PADDED, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, _PADDED)[starts].copy()
    rows[np.arange(_PADDED) >= left[:, None]] = 0
    return rows, first


def _convolve(model: Model, rows: np.ndarray) -> np.ndarray:
    """Filter values (chunks, WINDOWS, FILTERS)."""
    out = np.broadcast_to(model.bias, (len(rows), WINDOWS, FILTERS)).copy()
    for j in range(WIDTH):
        out += model.tables[j][rows[:, j : j + CHUNK : STEP]]
    return out


def _combine(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 3): mean, least and largest chunk logit of each text."""
    at = first[:-1]
    return np.stack((np.add.reduceat(logits, at) / np.diff(first), np.minimum.reduceat(logits, at), np.maximum.reduceat(logits, at)), axis=1)


def score_slice(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text of a slice."""
    rows, first = chunks_of(buf, offsets)
    pooled = np.concatenate([_convolve(model, rows[i : i + 256]).max(axis=1) for i in range(0, len(rows), 256)])
    x = _combine(np.maximum(pooled, 0) @ model.weight, first) @ model.combine + model.offset
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the log loss over whole texts."""
    rng = np.random.default_rng(seed)
    prior = min(max(float(labels.mean()) if len(labels) else 0.5, 0.02), 0.98)
    p = {
        "tables": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "weight": rng.normal(0, 0.3, FILTERS).astype(np.float32), "combine": np.array([0.4, 0.3, 0.3], np.float32), "offset": np.array([np.log(prior / (1 - prior))], np.float32),
    }
    model = lambda: Model(p["tables"], p["bias"], p["weight"], p["combine"], float(p["offset"][0]))
    if not len(labels) or labels.min() == labels.max():
        p["weight"][:] = 0
        return model()
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    prepared = [chunks_of(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in texts]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            rows = np.concatenate([prepared[j] for j in own])
            first = np.concatenate(([0], np.cumsum([len(prepared[j]) for j in own])))
            at = np.empty((len(rows), FILTERS), np.int64)
            pooled = np.empty((len(rows), FILTERS), np.float32)
            for c in range(0, len(rows), 256):
                values = _convolve(model(), rows[c : c + 256])
                at[c : c + 256] = best = values.argmax(axis=1)
                pooled[c : c + 256] = np.take_along_axis(values, best[:, None], axis=1)[:, 0]
            h = np.maximum(pooled, 0)
            logits = h @ p["weight"]
            z = _combine(logits, first)
            y = 1 / (1 + np.exp(-np.clip(z @ p["combine"] + p["offset"][0], -30, 30)))
            d = (y - labels[own]) / len(own)
            n = np.diff(first)
            d_logits = np.repeat(d * p["combine"][0] / n, n)
            for k, extreme in ((1, np.minimum), (2, np.maximum)):
                hit = logits == np.repeat(extreme.reduceat(logits, first[:-1]), n)
                d_logits += hit * np.repeat(d * p["combine"][k] / np.add.reduceat(hit.astype(float), first[:-1]), n)
            d_h = np.outer(d_logits, p["weight"]) * (pooled > 0)
            grad = {"weight": d_logits @ h, "combine": d @ z, "offset": np.array([d.sum()]), "bias": d_h.sum(axis=0)}
            table = np.zeros(p["tables"].size)
            r, f = np.nonzero(d_h)
            for j in range(WIDTH):
                byte = rows[r, at[r, f] * STEP + j].astype(np.int64)
                table += np.bincount((j * 256 + byte) * FILTERS + f, d_h[r, f], table.size)
            grad["tables"] = table.reshape(p["tables"].shape) + decay * p["tables"]
            t += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= (rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 3000, sample_bytes: int = 1 << 16,
          id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, of texts of at most ``sample_bytes``: the bounds of what reaches the driver.

    Of all rows that qualify those with the lowest hashes are taken, so long texts don't make the sample smaller.
    """
    wanted = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
        .where(~held_out("id"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fitting = texts.select("id", F.octet_length("text").alias("size")).where(F.col("size") <= sample_bytes).select("id").distinct()
    picked = wanted.join(fitting, "id").orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = texts.where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(picked), "id").orderBy("id", "text", "label").limit(sample_rows).select("text", "label").toArrow()
    return fit([t.encode() for t in rows.column("text").to_pylist()], np.asarray(rows.column("label"), np.float64), **options)


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 of a text column."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([score_slice(model, buf, offsets) for _, _, buf, offsets in slices(texts)] or [np.zeros(0)]).astype(np.float64))

    return F.arrow_udf(run, DoubleType())(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct (score, predicted: 1 if score >= threshold), and that column's name, which no other has."""
    name, raw = free_name(docs, "quality"), free_name(docs, "score")
    result = F.struct(F.col(raw).alias("score"), (F.col(raw) >= threshold).cast("int").alias("predicted"))
    return docs.withColumn(raw, score(model, F.col(text_col))).withColumn(name, result).drop(raw), name
