"""Jaccard join, fingerprints, licenses, packing on odd inputs and against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import fingerprints as FP
from tidewell.llm import licenses, ngramjoin, packing
from tidewell.llm import textkit as T


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = [x for x in re.split("[ \t-\r]+", lower(text)) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def plain_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[find(i)].append(d)
    least = {r: min((d for d in own if d is not None), default=None) for r, own in ids.items()}
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))


def components(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.link_components(df).collect())


def test_join_on_odd_rows(odd, empty):
    assert components(odd) == plain_components([(r.doc_id, r.text) for r in odd.collect()])
    assert ngramjoin.link_components(empty).count() == 0


def test_join_on_sample(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert components(df) == plain_components([(r.doc_id, r.text) for r in df.collect()])


def near_copies(seed, n, words=60):
    """Groups of near copies at all distances, a passage that most share, short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    passage = [rng.choice(vocab) for _ in range(20)]
    base = [[rng.choice(vocab) for _ in range(words)] for _ in range(4)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.5:
            w = w[: rng.randrange(5, words)] + passage
        docs.append((i, " ".join(w if rng.random() < 0.9 else w[: rng.randrange(0, 7)])))
    return docs


@pytest.mark.parametrize("seed,rare,block", [(1, 24, 8), (2, 3, 8), (3, 1, 16), (4, 2, 512)])
def test_join_is_exact_whatever_is_rare(spark, monkeypatch, seed, rare, block):
    monkeypatch.setattr(ngramjoin, "RARE", rare)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "CELL_BITS", 16 + 5 * (seed % 3))
    docs = near_copies(seed, 160)
    assert components(spark.createDataFrame(docs, "doc_id long, text string")) == plain_components(docs)


def test_prefixes_share_a_signature():
    """Any two sets with similarity 3/4 or more index a common signature, for any marking of tokens."""
    rng = np.random.default_rng(5)
    for trial in range(400):
        n = int(rng.integers(1, 60))
        whole = np.unique(rng.integers(0, 1 << 62, 2 * n + 2, dtype=np.uint64))
        a = whole[:n]
        drop, add = rng.integers(0, max(1, n // 4 + 1), 2)
        b = np.sort(np.concatenate((np.delete(a, rng.permutation(n)[:drop]), whole[n : n + add])))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 75 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        share = rng.random()
        marks = {int(t): rng.random() < share for t in whole}
        sigs = []
        for s in (a, b):
            often = np.array([marks[int(t)] for t in s])
            take, rare = ngramjoin._prefix(np.array([0, len(s)]), often)
            own = set(s[take].tolist())
            if rare[0] < len(s) // 4 + 1:
                own |= {("pair", x) for x in ngramjoin.pair_signatures(s, often).tolist()}
            sigs.append(own)
        assert sigs[0] & sigs[1], (trial, len(a), len(b), both)


def test_keep_one(spark, odd, empty):
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5, 6, 7, 8, 9, None, None])
    assert ngramjoin.keep_one(empty).count() == 0


def test_keep_one_compares_rows_without_id(spark):
    docs = [(None if i % 3 else i - 3 * (1 << 61) * (i % 2), t) for i, t in near_copies(7, 120)]
    docs += [(None, "one two three four five six lost"), (None, "one two three four five six lost"), (None, " \t"), (None, None), (None, None)]
    docs += [(None, "a null beside the largest id here"), ((1 << 63) - 1, "a null beside the largest id here")]
    kept = Counter((r.doc_id, r.text) for r in ngramjoin.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    # Rows with an own number each, those without an id last: what stays is the least of each component.
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    groups = defaultdict(list)
    for (i, n, c), _ in plain_components([(k, t) for k, (_, t) in enumerate(order)]).items():
        groups[c].append((i, n))
    sets = {c: {shingle_set(order[i][1]) for i, _ in own} for c, own in groups.items()}
    for c, own in groups.items():
        stay = [(d, t) for d, t in kept if (d, t) == order[c] or order[c][0] is None and d is None and shingle_set(t) in sets[c]] if own[0][1] else []
        assert not own[0][1] or len(stay) == 1 and kept[stay[0]] == 1, order[c]
    empty = Counter(d for d in docs if not shingle_set(d[1]))
    assert all(kept[d] == n for d, n in empty.items())
    assert sum(kept.values()) == len(groups)


def test_words_and_shingles_by_brute_force():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aB c\n\té日 .1-") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", None, "x" * 3_000_000, "a b c d e " * 200_000]
    seen = {}
    for table, pattern in ((T.SPACED, r"[^ \t-\r]+"), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hasher, row = T.WordHasher(table), 0
        for a, b, buf, offsets in T.slices(pa.array(texts)):
            hashes, starts, ends, first = hasher.words(buf, offsets)
            for t in range(b - a):
                words = re.findall(pattern, lower(texts[row]))
                own = hashes[first[t] : first[t + 1]].tolist()
                assert len(own) == len(words)
                for w, h in zip(words[:500], own):
                    assert seen.setdefault((pattern, w), h) == h
                row += 1
        assert row == len(texts)
    assert len({h for h in seen.values()}) == len({w for _, w in seen})


def test_fingerprints_walk(spark, odd, empty):
    rows = FP.with_next(odd).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda d: (d[0] is None, -(d[0] or 0)))
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((d, len(t)) for d, t in docs)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        if d is not None and d not in (4, 1):
            assert by[d].edited_sha256 == hashlib.sha256(FP.edited(t, nxt).encode()).hexdigest(), d
    same = {r.fingerprint for r in rows if r.doc_id in (1, 4)}
    assert len(same) == 1
    assert FP.with_next(empty).count() == 0
    one = FP.with_next(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_on_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in FP.with_next(docs).collect()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for d, n in zip(ids, ids[1:] + ids[:1]):
        e = FP.edited(texts[d], texts[n])
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        errors += [abs(got[d].near_edited - jac(shingle_set(texts[d]), shingle_set(e))), abs(got[d].near_next - jac(shingle_set(texts[d]), shingle_set(texts[n])))]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.02


def test_sketches_merge_and_estimate():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    hasher = T.WordHasher(T.SPACED)
    sa, sb, whole = FP.sketches(pa.array([a, b, " ".join(words)]), hasher)
    assert (FP.merge([sa, sb]) == whole).all()
    assert FP.resemblance(sa, sb) == pytest.approx(0.5, abs=0.15)
    assert FP.containment(sa, whole) == 1.0 and FP.containment(whole, sa) == pytest.approx(0.75, abs=0.15)
    assert FP.distinct_count(whole) == pytest.approx(3996, rel=0.3)
    assert (FP.decode(FP.encode(whole)) == whole).all() and len(FP.decode("")) == 0


def test_licenses(spark, odd, empty):
    body = next(t for label, t in licenses.TEMPLATES if t.startswith("permission is hereby")).split()
    edited = " ".join(body[:6] + ["really"] + body[6:12] + body[13:]).title()
    docs = [(1, "cc-by cc by, CC BY all rights reserved"), (2, f"x y {edited}. end"), (3, "general public. license General Public License"), (4, "rights reserved all by cc"), (5, "cc"), (6, "a b " * 5000 + "cc by"), (7, "ccby all rights  RESERVED"), (7, "ccby all rights  RESERVED")]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    assert [(got[i][0].n_words, got[i][0].n_base, got[i][0].first_word, got[i][0].last_word, got[i][0].base_labels) for i in range(1, 8)] == [
        (9, 4, 0, 6, "cc-by,reserved"), (len(edited.split()) + 3, 0, None, None, ""), (6, 2, 0, 3, "gpl"), (5, 0, None, None, ""), (1, 0, None, None, ""), (10002, 1, 10000, 10000, "cc-by"), (4, 1, 1, 1, "reserved")]
    assert got[2][0].labels == "mit" and 0.7 <= got[2][0].score < 1 and len(got[7]) == 2 and got[4][0].score == 0
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def plain_licenses(text, band=3, least=0.7):
    """(n_words, base places, labels) of a text, straight from the definition."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    labels, base = set(), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        base += at
        labels |= {label} if at else set()
    for label, template in licenses.TEMPLATES:
        p = re.findall(r"[a-z0-9]+", template)
        places = defaultdict(list)
        for i in range(len(words) - 1):
            places[words[i], words[i + 1]].append(i)
        hits = [(j, i) for j in range(len(p) - 1) for i in places.get((p[j], p[j + 1]), ())]
        for d in {i - j for j, i in hits}:
            own = sorted((j, i) for j, i in hits if d <= i - j <= d + band)
            length = []
            for x, (j, i) in enumerate(own):
                length.append(1 + max((length[y] for y in range(x) if own[y][0] < j and own[y][1] < i), default=0))
            if max(length, default=0) >= least * (len(p) - 1):
                labels.add(label)
    return len(words), base, labels


def test_licenses_equal_a_plain_scan(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(8)
    for i, (_, template) in enumerate(licenses.TEMPLATES * 8):
        w = ["pre", "fix"] * rng.randrange(3) + template.split() + ["and", "more"] * rng.randrange(3)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(["the", "of", "software", "odd"])] * rng.randrange(2)
        docs.append((10**6 + i, " ".join(w)))
    docs += [(2 * 10**6, "of the " * 200), (2 * 10**6 + 1, "the software and the software or " * 60), (2 * 10**6 + 2, " ".join(reversed(licenses.TEMPLATES[3][1].split())))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    some = 0
    for d, text in docs:
        n, base, labels = plain_licenses(text)
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(base, default=None), max(base, default=None)), d
        assert r.labels == ",".join(sorted(labels)), (d, r.labels, labels)
        some += bool(labels)
    assert some > 60 and all(got[2 * 10**6 + k].labels == "" and got[2 * 10**6 + k].score == 0 for k in range(3))


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packing(rows, docs):
    ids = defaultdict(Counter)
    for (d, _), own in zip(docs, plain_ids(t for _, t in docs)):
        for at in range(0, len(own), 2048):
            piece = own[at : at + 2048]
            ids[d][(at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(own))] += 1
    got = defaultdict(Counter)
    seqs = defaultdict(list)
    for r in rows:
        got[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        seqs[r.sequence_id].append((r.offset, r.length))
    assert got == ids
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in rows) / 2048 / max(1, len(seqs))


def test_packing(spark, sf, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert check_packing(packing.pack(docs, path).collect(), [tuple(r) for r in docs.collect()]) > 0.97
    check_packing(packing.pack(odd, path).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(empty, path).count() == 0


def test_tokens_equal_the_tokenizer_on_odd_texts():
    import public_tokenizers

    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Foo's, don't!! <|endoftext|>, <|ENDOFTEXT|> X.", "é, ÉCOLE. ΟΔΟΣ İstanbul, á, b\x1cc d e f. 12,34 …, ª. x\x85y \x0b z's.", "é. ́, ﬁ, Ǆ. K, ß!", "", " ", "a.b.c,, ,", "日本語, 中文. ١٢٣, Ⅷ, ²,", "x" * 5000 + ","]
    for text, want in zip(texts, plain_ids(texts)):
        assert np.frombuffer(words.ids_of(text.encode()), "<u4").tolist() == want[:-1], text


def test_tokens_equal_the_tokenizer_for_every_letter_before_punctuation():
    import public_tokenizers

    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    texts = [f"a{c}{t} {c}{t}" for c in letters for t in (".", "?!")]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [t for t, ids in zip(texts, want) if np.frombuffer(words.ids_of(t.encode()), "<u4").tolist() != ids]
    assert "\u0130" in letters and "\u0958" in letters and not bad, bad[:10]


def test_cutting_stock_is_close_to_its_bound():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 20_000):
        lengths = rng.choice(np.arange(1, 257), n, p=np.arange(256, 0, -1) / np.arange(1, 257).sum())
        demand = np.bincount(lengths - 1, minlength=256)
        patterns = packing.solve(demand)
        held = sum((c * k for c, k in patterns), np.zeros(256, int))
        assert (held >= demand).all() and all((c * np.arange(1, 257)).sum() <= 256 for c, _ in patterns)
        used = sum(k for _, k in patterns)
        assert used <= -(-lengths.sum() // 256) + 0.01 * used + 3
