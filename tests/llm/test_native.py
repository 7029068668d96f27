"""Sharding, mixing, secrets and line dedup on odd inputs."""
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.llm import linededup, mixing, secrets, sharding


def test_interleave(spark, odd, empty):
    rows = sharding.interleave(odd, 3, carry={"size": F.coalesce(F.octet_length("text"), F.lit(0)) + 1}).collect()
    assert len(rows) == odd.count() and sorted(r.place for r in rows) == list(range(len(rows)))
    per = Counter(r.shard for r in rows)
    assert set(per) == {0, 1, 2} and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert sharding.interleave(empty, 3).count() == 0


def test_interleave_matches_the_mixture(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = sharding.interleave(df, 8, carry={"s": F.col("source")}).collect()
    whole, by = Counter(r.s for r in rows), defaultdict(Counter)
    for r in rows:
        by[r.shard][r.s] += 1
    assert all(abs(by[k][s] - n / 8) <= 1.5 for k in range(8) for s, n in whole.items())
    again = sharding.interleave(df.orderBy(F.rand(1)).repartition(5), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_rates_fill_by_weight(spark):
    def plain(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
        w = [weights[i % 3] for i in range(len(sizes))]
        capped, budget = set(), share * sum(sizes)
        while True:
            left = budget - sum(cap * sizes[i] for i in capped)
            total = sum(w[i] for i in range(len(sizes)) if i not in capped)
            over = {i for i in range(len(sizes)) if i not in capped and left * w[i] / total > cap * sizes[i]} if total else set()
            if not over:
                return [cap * sizes[i] if i in capped else left * w[i] / total for i in range(len(sizes))]
            capped |= over

    for sizes in ([100, 100, 100], [1, 1000, 1000, 5, 70], [0, 10, 20], [7], [3, 3, 3, 3, 3, 3, 90]):
        df = spark.createDataFrame([(chr(97 + i), s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.rates(df).orderBy("source").collect()]
        assert got == pytest.approx(plain(sizes))


def test_mix(spark, odd, empty):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 20 as int))").alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    taken, m = mixing.take(docs, mixing.n_words())
    rows = taken.collect()
    for s in {r.source for r in rows}:
        own = [r[m] for r in rows if r.source == s]
        assert sum(m.size * m.copies for m in own) == pytest.approx(own[0].target, rel=0.1)
        assert all(m.copies in (int(m.rate), int(m.rate) + 1) and m.copies <= 2 for m in own)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r[m].copies for r in rows)
    assert {r.doc_id: r.copies for r in mixing.take(docs.repartition(7), mixing.n_words())[0].select("doc_id", f"{m}.copies").collect()} == {r.doc_id: r[m].copies for r in rows}
    mixed, m = mixing.take(odd, mixing.n_words())
    assert mixed.columns == [*odd.columns, m] and sorted(map(str, mixed.drop(m).collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(odd).columns == odd.columns and all(r.mix == r.copy == r.mix_key == "x" for r in mixing.mix(odd).collect())
    assert mixing.take(empty, mixing.n_words())[0].count() == 0 and mixing.mix(empty).count() == 0


SECRET = "x AKIA" + "A" * 16 + "\nTOKEN = 'abcdef12' secret: token: abcdefgh " + "deadbeef" * 3 + " 🎉 password=hi api-key=ABCDEFGH ApiKey:\"zzzzzz\""


def test_secret_spans_and_ledger(spark, odd, empty, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    v1 = spark.createDataFrame([(1, SECRET), (2, SECRET), (3, "nothing"), (None, SECRET), (4, None)], "path long, text string")

    def found(versions, rules=secrets.RULES):
        return sorted(((r.path, [(s.start, s.end, s.kind) for s in r.spans]) for r in ledger.join_back(ledger.scan(versions, rules), rules).collect()), key=str)

    out = dict(found(v1))
    spans = [(SECRET[a:b], k) for a, b, k in out[1]]
    assert spans == [("AKIA" + "A" * 16, "access"), ("TOKEN = 'abcdef12", "assign"), ("deadbeef" * 3, "hex"), ('ApiKey:"zzzzzz', "assign")]
    assert out[2] == out[1] == out[None] and out[3] == out[4] == []
    assert ledger.scanned().count() == 3
    found(v1)
    assert ledger.scanned().count() == 3  # nothing is scanned twice
    newer = tuple(r._replace(version="2") if r.kind == "hex" else r for r in secrets.RULES)
    assert dict(found(v1, newer))[1] == out[1]
    assert sorted(map(len, (r.rules for r in ledger.scanned().collect()))) == [1, 1, 1, 7, 7, 7]
    assert len(found(odd.withColumnRenamed("doc_id", "path"))) == odd.count()
    assert found(empty.withColumnRenamed("doc_id", "path")) == []


def plain_dedup(docs):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    first = {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), d)
    return Counter((d, (lambda ls, kept: (len(ls), len(ls) - len(kept), "\n".join(kept)))((t or "").split("\n"), [x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d])) for d, t in docs)


def test_line_dedup(spark, odd, empty):
    rows, d = linededup.dedup(odd)
    assert d not in odd.columns and rows.columns == [*odd.columns, d] and sorted(map(str, rows.drop(d).collect())) == sorted(map(str, odd.collect()))
    got = Counter((r.doc_id, (r[d].n_lines, r[d].n_dropped, r[d].text)) for r in rows.collect())
    assert got == plain_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert linededup.dedup(empty)[0].count() == 0


def test_line_dedup_hot_line_and_many_lines(spark):
    docs = [(i, "\n".join(["a line that all of them share", *(f"own line {i} {j} abcdef" for j in range(i % 5)), "A Line That all of them share ", f"x{i}"] + ["pad pad pad pad"] * (150 if i == 3 else 0))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, (r.deduped.n_lines, r.deduped.n_dropped, r.deduped.text)) for r in linededup.dedup(df)[0].collect())
    assert got == plain_dedup(docs)


def test_hashes_of_kept_text(spark, sf):
    from tidewell.llm.queries import op10_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, (n, k, t)), c in plain_dedup(docs).items() for _ in range(c))
    assert Counter(tuple(r) for r in op10_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want
