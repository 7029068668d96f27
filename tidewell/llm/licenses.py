"""License scans by diagonal voting.

All rolling 2-word hashes of all texts are Spark-joined to the positions of
those hashes in the license templates (a fixed, small table, so it is
broadcast). A hit at word i of a text and word j of a template votes for the
diagonal i - j: a copy of the template gathers its votes on one diagonal, and an
insertion or deletion moves the rest to a neighbouring one. What is kept of a
diagonal is the set of template positions that voted, as bits. A span is a window
of ``band`` diagonals from one that has votes; it is verified twice: by the share of *distinct* template
positions that it holds, and by the longest chain of these whose places in the
text rise with them, so words that merely recur, or stand in another order, don't
make a span. Short phrases need all positions on one diagonal (then each word
stands where the phrase has it), the longer templates a chain of ``least`` of
them, since edited copies count too. Of verified windows that overlap the one with
the longest chain stays.

Texts never leave the scan: what is shuffled are votes, summed before the
shuffle. Hashes travel in runs of at most ``RUN`` words, so a very long text is
many rows. A text's votes carry the text's hash beside its id, and are divided by how often
that same row occurs, so repeated rows don't count twice.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: null text is empty; texts without words have no labels, score 0;
null ids are kept; repeated rows each get the result of one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.textkit import ALNUM, WordHasher, mix64, slices

RUN = 4096

# Phrases (found word by word) and templates (found by coverage), each with its label.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("creative-commons", "this work is licensed under a creative commons attribution license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)


def _grams(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(3) + words[1:]).view(np.int64)


def template_positions(spark: SparkSession) -> DataFrame:
    """Rows (gram, template, j, size, phrase, label): one per 2-word position of a template.

    Template -1 at gram 0 stands for a document itself: it answers the one mark
    that each document sends, so documents without any vote stay in the result.
    """
    hasher, rows = WordHasher(ALNUM), [(0, -1, 0, 1, False, "")]
    for t, (label, text) in enumerate((*PHRASES, *TEMPLATES)):
        raw = text.encode()
        words = hasher.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        if len(words) > 64:
            raise ValueError(f"a template may have 64 words, as its positions are bits of a number: {text}")
        rows += [(g, t, j, len(words) - 1, t < len(PHRASES), label) for j, g in enumerate(_grams(words).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, j int, size int, phrase boolean, label string")


def rolling(docs: DataFrame) -> DataFrame:
    """From rows (id, th, text): rows (id, th, n_words, at, grams), grams[i] that of words at + i and at + i + 1.

    A document's first row has its number of words (others null) and starts with
    the mark 0 at position -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ALNUM)
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column("text")):
                hashes, _, _, first = hasher.words(buf, offsets)
                grams = np.where(_grams(hashes) == 0, 1, _grams(hashes)) if len(hashes) else np.zeros(0, np.int64)
                n, rows, at, parts = np.diff(first), [], [], []
                for t in range(b - a):
                    own = grams[first[t] : first[t + 1] - 1] if n[t] > 1 else grams[:0]
                    parts.append(np.concatenate((np.zeros(1, np.int64), own[:RUN])))
                    rows.append(t)
                    at.append(-1)
                    for i in range(RUN, len(own), RUN):
                        parts.append(own[i : i + RUN])
                        rows.append(t)
                        at.append(i)
                take = pa.array(np.array(rows, np.int64) + a)
                starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                count = pa.array(n[np.array(rows)].astype(np.int64), mask=np.array(at) != -1)
                yield pa.record_batch({
                    "id": batch.column("id").take(take), "th": batch.column("th").take(take), "n_words": count, "at": pa.array(np.array(at, np.int64)),
                    "grams": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(np.concatenate(parts)))})

    return docs.mapInArrow(run, "id long, th long, n_words long, at long, grams array<long>")


def longest_chain(diagonals: list[int], masks: list[int]) -> tuple[int, int, int]:
    """Of hits (template position, place in the text) the longest chain that rises in both: (hits, first place, last place)."""
    hits = sorted((j, -(d + j)) for d, mask in zip(diagonals, masks) for j in range(64) if mask >> j & 1)
    best: list[tuple[int, int, int]] = []  # by length - 1: the chain that ends earliest, as (last place, first place, length)
    for _, negative in hits:  # one position's places come from the last, so a chain takes one of them
        place = -negative
        k = bisect_left(best, (place,))
        chain = (place, best[k - 1][1] if k else place, k + 1)
        best[k : k + 1] = [chain]
    return (best[-1][2], best[-1][1], best[-1][0]) if best else (0, 0, 0)


def _chains(windows: pa.Array) -> pa.Array:
    """The longest chain of each window, a list of (diagonal, mask)."""
    rows = [longest_chain([x["diagonal"] for x in w], [x["mask"] for x in w]) for w in windows.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["hits", "first", "last"])


def spans(docs: DataFrame, band: int = 3, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans and documents: rows (id, th, copies, n_words, template, label, phrase, start, end, coverage).

    Each distinct (id, text) has one row with template -1, where ``copies`` is
    how often it occurs. ``start`` and ``end`` are words from 0, end exclusive.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    hits = (
        rolling(slim).select("id", "th", "n_words", "at", F.posexplode("grams").alias("i", "gram"))
        .join(F.broadcast(template_positions(docs.sparkSession)), "gram")
        .withColumn("diagonal", F.col("at") + F.col("i") - F.col("j"))
    )
    votes = hits.groupBy("id", "th", "template", "label", "phrase", "size", "diagonal").agg(
        F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    own = Window.partitionBy("id", "th")
    line = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    held = F.bit_count(F.when(F.col("phrase"), F.col("mask")).otherwise(F.bit_or("mask").over(line.rangeBetween(0, band))))
    whole = F.col("template") < 0
    found = (
        votes.withColumn("copies", F.max(F.when(whole, F.col("votes"))).over(own)).withColumn("held", held)
        .withColumn("window", F.collect_list(F.struct("diagonal", "mask")).over(line.rangeBetween(0, band)))
        .where(F.when(F.col("phrase") | whole, F.col("held") == F.col("size")).otherwise(F.col("held") >= F.col("size") * least))
    )
    places = "id", "th", "copies", "n_words", "template", "label", "phrase"
    exact = found.where(F.col("phrase") | whole).select(*places, F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size") + 1).alias("end"), F.lit(1.0).alias("coverage"))
    chains = found.where(~F.col("phrase") & ~whole).withColumn("chain", F.arrow_udf(_chains, "struct<hits: long, first: long, last: long>")("window"))
    own = F.struct("coverage", -F.col("diagonal"))
    loose = (
        chains.withColumn("coverage", F.col("chain.hits") / F.col("size")).where(F.col("coverage") >= least)
        .withColumn("most", F.max(own).over(line.rangeBetween(-band, band))).where(own == F.col("most"))
        .select(*places, F.col("chain.first").alias("start"), (F.col("chain.last") + 2).alias("end"), "coverage")
    )
    return exact.unionByName(loose)


def scan(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    s = spans(docs, **options)
    base = F.col("phrase") & (F.col("template") >= 0)
    real = F.col("template") >= 0
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        s.groupBy("id", "th").agg(
            F.max("copies").alias("copies"), F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
            names(base).alias("base_labels"), names(real).alias("labels"),
            F.coalesce(F.max(F.when(real, F.col("coverage"))), F.lit(0.0)).alias("score"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(F.col("id").alias(options.get("id_col", "doc_id")), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
