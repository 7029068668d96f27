"""Classifier, nearest neighbours and the pipeline."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ann, quality


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 511, 512, 513, 960, 961, 5000):
        text = np.random.default_rng(n).integers(1, 256, n).astype(np.uint8)
        rows, first = quality.chunks_of(text, np.array([0, n]))
        seen = np.zeros(n, bool)
        for c in range(first[1]):
            at = c * (quality.CHUNK - quality.OVERLAP)
            own = text[at : at + quality.CHUNK]
            assert (rows[c, : len(own)] == own).all() and not rows[c, len(text[at : at + rows.shape[1]]) :].any()
            seen[at : at + len(own)] = True
        assert seen.all()


def test_gradient_learns_a_pattern():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, 700).astype(np.uint8)) for _ in range(120)]
    labels = np.array([i % 2 for i in range(120)], float)
    texts = [t[:300] + (b"&&&***" * 20 if y == 0 else b"") + t[300:] for t, y in zip(texts, labels)]
    model = quality.fit(texts[:90], labels[:90], epochs=60)
    scores = np.array([quality.score_slice(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts[90:]])
    assert ((scores >= 0.5) == labels[90:]).all()


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels)
    scored, q = quality.classify(docs, model)
    rows = scored.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").where(quality.held_out()).select(f"{q}.score", f"{q}.predicted", "y").collect()
    good, bad = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.y for r in rows]) > 0.9


def test_classifier_on_odd_rows(spark, odd, empty):
    none = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    scored, q = quality.classify(odd, none)
    rows = scored.collect()
    assert q not in odd.columns and scored.columns == [*odd.columns, q]
    assert len(rows) == odd.count() and all(r[q].score == 0.5 and r.quality == r.score == "x" for r in rows)
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    rows = quality.classify(odd, quality.train(odd, labels))[0].collect()
    assert len(rows) == odd.count() and all(0 <= r[q].score <= 1 for r in rows)
    assert quality.classify(empty, none)[0].count() == 0


def test_sample_is_of_rows_that_qualify(spark, monkeypatch):
    """Long texts don't make the sample smaller, and it has its bounds."""
    docs = spark.createDataFrame([(i, "x" * (50 if i % 3 else 5000)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, y, **_: seen.append([len(t) for t in texts]))
    quality.train(docs, labels, sample_rows=100, sample_bytes=1000)
    quality.train(docs, labels, sample_rows=10_000, sample_bytes=1000)
    free = sum(zlib.crc32(str(i).encode()) % 5 != 0 and i % 3 != 0 for i in range(300))
    assert seen == [[50] * 100, [50] * free]


def plain_score(model, text):
    """One text's probability, byte by byte."""
    step, logits = quality.CHUNK - quality.OVERLAP, []
    starts = [0]
    while starts[-1] + quality.CHUNK < len(text):
        starts.append(starts[-1] + step)
    for at in starts:
        logit = 0.0
        for f in range(quality.FILTERS):
            best = -np.inf
            for w in range(quality.WINDOWS):
                total = float(model.bias[f])
                for j in range(quality.WIDTH):
                    i = at + w * quality.STEP + j
                    total += float(model.tables[j, text[i] if i < len(text) else 0, f])
                best = max(best, total)
            logit += max(best, 0.0) * float(model.weight[f])
        logits.append(logit)
    x = float(np.dot([np.mean(logits), min(logits), max(logits)], model.combine)) + model.offset
    return 1 / (1 + np.exp(-x))


def random_model(rng):
    return quality.Model(
        rng.normal(0, 0.2, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32),
        rng.normal(0, 0.2, quality.FILTERS).astype(np.float32), np.array([0.4, 0.3, 0.3], np.float32), 0.1)


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(1)
    model = random_model(rng)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 8, 511, 512, 513, 960, 1300)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = quality.score_slice(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_first_step_follows_the_numeric_gradient():
    """Adam's first step goes against the sign of each parameter's gradient; compared with differences of the log loss."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (300, 700, 900, 100)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    before = quality.fit(texts, labels, epochs=0, decay=0.0)
    after = quality.fit(texts, labels, epochs=1, batch=4, decay=0.0)

    def loss(model):
        p = np.array([plain_score(model, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    tried = 0
    for f in range(0, quality.FILTERS, 5):
        for name in ("bias", "weight"):
            old, new = getattr(before, name)[f], getattr(after, name)[f]
            up, down = (before._replace(**{name: np.where(np.arange(quality.FILTERS) == f, old + d, getattr(before, name)).astype(np.float64)}) for d in (1e-3, -1e-3))
            slope = (loss(up) - loss(down)) / 2e-3
            if abs(slope) > 1e-4:
                assert np.sign(new - old) == -np.sign(slope), (name, f, slope)
                tried += 1
    assert tried >= 4


def recall(vectors, queries, found, k=20):
    hit = total = 0
    for q in queries:
        scores = {i: float(np.dot(vectors[q], v)) for i, v in vectors.items() if i != q}
        best = sorted(scores.values(), reverse=True)[:k]
        own = sorted(((r.rank, r.vec_id, r.score) for r in found if r.query_id == q))
        assert len(own) == len(best) and [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert all(s == pytest.approx(scores[i], abs=1e-9) for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hit += sum(s >= best[-1] - 1e-9 for _, _, s in own)
        total += len(best)
    return hit / total


def test_nearest_recall(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    assert recall(vectors, [i for i in vectors if i % 20 == 0], ann.nearest(df, F.col("vec_id") % 20 == 0).collect()) >= 0.9
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    assert recall(vectors, [i for i in vectors if i % 20 == 0], ann.nearest(df, F.col("vec_id") % 20 == 0).collect()) >= 0.9


def test_nearest_inner_product_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.1, 3)]) for i in range(200)]
    same = rows[40][1]
    rows += [(300 + i, same) for i in range(60)]
    bad = [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] + [1.0] * 7), (580, [float("inf")] + [1.0] * 7), (None, same)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.where("vec_id < 500").collect()}
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    queries = [i for i in vectors if i % 20 == 0]
    assert {r.query_id for r in found} == set(queries)
    assert recall(vectors, queries, found) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        if i in (0, 2):
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if i == 1:
            old = {r.doc_id: r.text for r in before.collect()}
            assert all(r.n_chars == len(r.text) <= len(old[r.doc_id]) for r in docs.collect())
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    assert Counter(r.doc_id for r in docs.collect())
    assert P.run(spark, sf).count() == counts[-1]


def test_pipeline_stages_equal_plain_versions(spark, sf):
    """Each stage's rows against plain Python, on shared lines, near copies and several sources."""
    import hashlib
    import re

    import corpus_pipeline as P
    from test_native import plain_dedup
    from test_text_operators import check_packing, near_copies, plain_components

    stages = [f for _, f in P.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = Counter()
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        good[r] += int(quality.score_slice(model, raw, np.array([0, len(raw)]))[0] >= 0.3)
    assert Counter(stages[0](spark, docs, sf).collect()) == +good and 0 < good.total() < docs.count()

    texts = [(i, t + ("\na line that many share\n" if i % 3 else "\nshort") + f"own line of {i}") for i, t in near_copies(11, 90)]
    rows = [(i, t, len(t), "abc"[min(2, i % 7)]) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string")
    source = {i: s for i, _, _, s in rows}

    lines = {d: (n, t) for d, (_, n, t) in plain_dedup(texts)}
    want = [(d, lines[d][1], len(lines[d][1]), source[d]) for d, _ in texts]
    docs = spark.createDataFrame(got := sorted(map(tuple, stages[1](spark, docs, sf).collect())), docs.schema)
    assert got == want and any(n for n, _ in lines.values())

    least = {d: c for d, n, c in plain_components([(d, t) for d, t, _, _ in want]) if n}
    want = [r for r in want if least.get(r[0], r[0]) == r[0]]
    docs = spark.createDataFrame(got := sorted(map(tuple, stages[2](spark, docs, sf).collect())), docs.schema)
    assert got == want and 3 < len(want) < len(rows)

    words = {d: len(re.findall(r"[^ \t-\r]+", t)) for d, t, _, _ in want}
    size = {s: sum(words[r[0]] for r in want if r[3] == s) for s in "abc"}
    weight, capped, budget = dict(zip("abc", (5, 2, 1))), set(), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(2.0 * size[s] for s in capped)) / (sum(weight[s] for s in weight if s not in capped) or 1)
        over = {s for s in weight if s not in capped and level * weight[s] > 2.0 * size[s]}
        if not over:
            break
        capped |= over
    rate = {s: 2.0 if s in capped else level * weight[s] / size[s] for s in weight}
    draw = lambda d: int(hashlib.md5(f"mix-0:{d}".encode()).hexdigest()[:13], 16) / 2**52
    want = [r for r in want for _ in range(int(rate[r[3]]) + (draw(r[0]) < rate[r[3]] % 1))]
    docs = spark.createDataFrame(got := sorted(map(tuple, stages[3](spark, docs, sf).collect())), docs.schema)
    assert got == want and len(set(want)) < len(want)

    check_packing(stages[4](spark, docs, sf).collect(), [r[:2] for r in want])


def test_arrow_batches_are_bounded(spark):
    from tidewell.llm import workdir

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for held, want in (("64MB", str(workdir.BATCH_BYTES)), ("1k", "1k"), (str(workdir.BATCH_BYTES), str(workdir.BATCH_BYTES))):
            spark.conf.set(name, held)
            workdir.bound_batches(spark)
            assert spark.conf.get(name) == want
        spark.conf.set(name, "4k")
        long = spark.createDataFrame([(i, "word " * (5000 if i % 7 == 0 else 3)) for i in range(40)], "doc_id long, text string")
        import public_tokenizers

        from tidewell.llm import packing

        small = sorted(packing.token_pieces(long, public_tokenizers.path("word_bpe_49k.json")).collect())
        spark.conf.set(name, "64MB")
        assert small == sorted(packing.token_pieces(long, public_tokenizers.path("word_bpe_49k.json")).collect())
    finally:
        spark.conf.set(name, before)


def test_collisions_are_counted_as_plainly():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((5000, 24))
    largest = float(np.sqrt((vectors**2).sum(axis=1)).max())
    index, queries = ann.SortedProjections(vectors, largest), vectors[:40]
    centres = (queries * (largest / np.sqrt((queries**2).sum(axis=1)))[:, None]) @ index.a[:-1]
    at = vectors @ index.a[:-1] + np.outer(np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0)), index.a[-1])
    widths = np.full(len(queries), index.first_width)
    bits = index._collide(centres, widths, index.before.shape[2])
    rank, n, least = at.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable"), len(vectors), int(np.ceil(ann.THRESHOLD * index.m))
    for q, row in enumerate(bits):
        # Windows are rounded out to edges, which lie before every (n / PARTS)-th rank.
        low = [index.edges[p].searchsorted(centres[q, p] - widths[q], "left") * n // ann.PARTS for p in range(index.m)]
        high = [(index.edges[p].searchsorted(centres[q, p] + widths[q], "right") + 1) * n // ann.PARTS for p in range(index.m)]
        inside = np.abs(at - centres[q]) <= widths[q]
        window = (rank >= low) & (rank < high)
        assert not (inside & ~window).any()
        found = np.unpackbits(row.view(np.uint8), count=n, bitorder="little")
        assert (found == (window.sum(axis=1) >= least)).all()
    wanted = np.full(len(queries), 200)
    assert all(200 <= len(c) < n / 2 for c in index.candidates(queries, wanted))
    assert all(len(c) == n for c in index.candidates(queries, np.full(len(queries), n)))
    # Fewer rows than parts, all of them wanted but one.
    few = ann.SortedProjections(vectors[:7], largest)
    assert all(len(c) >= 6 for c in few.candidates(queries, np.full(len(queries), 6)))


@pytest.mark.parametrize("count, least", [(1, 1), (2, 2), (5, 3), (13, 8), (100, 64), (128, 109), (3, 9)])
def test_bit_sets_add_up(count, least):
    rng = np.random.default_rng(count)
    sets, counters = rng.integers(0, 2, (count, 192), dtype=np.uint8), ann.Counters()
    for s in sets:
        counters.add(np.packbits(s, bitorder="little").view(np.uint64).copy())
    got = np.unpackbits(counters.at_least(least).view(np.uint8), bitorder="little")
    assert (got == (sets.sum(axis=0, dtype=int) >= least)).all()
