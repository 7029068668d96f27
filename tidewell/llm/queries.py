"""The queries of this subpackage: thin digests of the operators' outputs, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import ann, fingerprints, licenses, linededup, mixing, ngramjoin, packing, quality, secrets, sharding
from tidewell.llm.workdir import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored, result = quality.classify(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), f"{result}.score", f"{result}.predicted")


def op2_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op3_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    placed = sharding.interleave(docs, 16, carry={"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed, result = mixing.take(docs, mixing.n_words())
    taken = (F.col(result)["size"] * F.col(result)["copies"]).alias("taken")
    return mixed.select("doc_id", f"{result}.size", f"{result}.source_size", f"{result}.target", taken)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, new_path(spark, "secret-ledger"))
    paths = ledger.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    found = ledger.join_back(paths)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"), *(count(k) for k in secrets.BASE),
        F.sha2(secrets.render(base), 256).alias("base_sha256"), secrets.render(F.col("spans")).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    deduped, result = linededup.dedup(docs)
    return deduped.select("doc_id", f"{result}.n_lines", f"{result}.n_dropped", F.sha2(F.col(result)["text"], 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_cnn, op2_cutting_stock, op3_stratified_interleave, op4_collision_counting, op5_license_diagonals, op6_mix_sources, op7_secret_ledger, op8_ngram_jaccard, op9_bottom_k, op10_line_dedup)}


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5('tidewell-0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM d
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), coalesce('s' || source, 'n'), h, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
  'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard,
  CAST(place - ((place * 16 // total) * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS most,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS i,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s
), t AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most ELSE (SELECT arg_min(level, i) FROM f WHERE most > level * weight) * weight END AS target FROM f
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
"""


def _op7_sql() -> str:
    def one(k: int, r: secrets.Rule) -> str:
        p = "'" + r.pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(regexp_split_to_array(text, {p})[:-2]) AS gap, unnest(regexp_extract_all(text, {p})) AS m,
          unnest(regexp_extract_all(text, {p}, {r.group})) AS told, {r.least} AS least, unnest(range(len(regexp_extract_all(text, {p})))) AS i FROM d"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(one(k, r) for k, r in enumerate(secrets.RULES))}),
s AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) - length(m) AS BIGINT) AS start FROM m),
f AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || start + length(m), ',' ORDER BY start, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || start + length(m), ',' ORDER BY start, k) AS spans
  FROM s WHERE length(told) >= least GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), k AS (
  SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_stratified_interleave": OP3_SQL, "op6_mix_sources": OP6_SQL, "op7_secret_ledger": _op7_sql(), "op8_ngram_jaccard": OP8_SQL, "op10_line_dedup": OP10_SQL}
