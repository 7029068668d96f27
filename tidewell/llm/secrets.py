"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by its SHA-256. A ledger keeps, for each
blob, the rule versions it was scanned under and what they found. A run scans
only blobs with rule versions the ledger lacks, one representative per blob
however many paths hold it, and joins findings back to all paths.

Match places without Python: for a pattern P, ``split(text, P, -1)`` gives what
lies between matches and ``regexp_extract_all`` the matches; summing lengths
(code points) gives every start. Sums run in a window over the match rows, so a
text with very many matches costs no more than linear work.

Defined cases: null text is the empty text; a null path counts as one path and
comes back null; repeated rows are scanned once and each returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    version: str
    pattern: str
    #: A cheap test that every text with a kept match passes.
    hint: str
    #: Matches whose group ``group`` has fewer than ``least`` code points are dropped.
    group: int = 0
    least: int = 1


# The rules, in the order in which spans with one start are listed.
_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
RULES = (
    Rule("assign", "1", _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "regex:" + _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", 2, 6),
    Rule("access", "1", "AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", "1", "[0-9a-f]+", "regex:[0-9a-f]{24}", 0, 24),
    Rule("pem", "1", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", "1", "gh[pousr]_[A-Za-z0-9]{36,}", "regex:gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "1", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("jwt", "1", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "eyJ"),
)
BASE = ("assign", "access", "hex")

_LAST = (1 << 63) - 1


def _name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _matches(rule: Rule, k: int, text: Column, pending: Column) -> Column:
    """Struct (k, kind, parts of (gap, len, ok)) of a text, null where the rule is not due or cannot match."""
    hint = text.rlike(rule.hint[6:]) if rule.hint.startswith("regex:") else text.contains(rule.hint)
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    told = whole if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.zip_with(
        F.arrays_zip(F.transform(whole, F.length).alias("len"), F.transform(told, lambda x: F.length(x) >= rule.least).alias("ok")),
        gaps, lambda m, gap: F.struct(gap.alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")))
    return F.when(F.array_contains(pending, _name(rule)) & hint, F.struct(F.lit(k).alias("k"), F.lit(rule.kind).alias("kind"), parts.alias("parts")))


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """From rows (blob, text, pending): rows (blob, k, kind, start, end), in code points, end exclusive."""
    each = F.filter(F.array(*(_matches(r, k, F.col("text"), F.col("pending")) for k, r in enumerate(rules))), lambda x: x.isNotNull())
    hits = (
        blobs.select("blob", F.explode(each).alias("x")).select("blob", "x.k", "x.kind", "x.parts")
        .dropDuplicates(["blob", "k"])
        .select("blob", "k", "kind", F.posexplode("parts").alias("i", "p"))
        .where("p.len is not null")  # the last gap has no match after it
    )
    w = Window.partitionBy("blob", "k").orderBy("i")
    start = F.sum(F.col("p.gap") + F.col("p.len")).over(w) - F.col("p.len")
    return (
        hits.withColumn("start", start.cast("long")).where("p.ok")
        .select("blob", "k", "kind", "start", (F.col("start") + F.col("p.len")).alias("end"))
    )


class Ledger:
    """What was scanned under which rule versions, and the findings, as two Parquet tables below ``path``.

    Findings are written before the scan marks: a run lost between the two is
    scanned again, and findings are read as a set.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob binary, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob binary, rule string, kind string, start long, end long")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Rows (path, blob) of ``versions`` (path, text), after all that the ledger lacks was scanned."""
        every = F.array(*(F.lit(_name(r)) for r in rules))
        v = versions.select(F.col("path"), F.coalesce(F.col("path").cast("long"), F.lit(_LAST)).alias("p"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        v = v.withColumn("blob", F.unhex(F.sha2("text", 256)))
        # One row per blob: path and address only, combined before the shuffle, so copies cost nothing here.
        blobs = v.groupBy("blob").agg(F.min("p").alias("p"))
        known = self.scanned().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("known"))
        due = blobs.join(known, "blob", "left").withColumn("pending", F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))).where("size(pending) > 0")
        # Joined by path first: each path has few versions, while one blob may be on a third of all paths.
        fresh = v.select("p", "blob", "text").join(due.select("p", F.col("blob").alias("due_blob"), "pending"), "p").where("blob = due_blob").select("blob", "text", "pending")
        name = F.element_at(every, F.col("k") + 1)
        find(fresh, rules).select("blob", name.alias("rule"), "kind", "start", "end").write.mode("append").parquet(f"{self.path}/findings")
        due.select("blob", F.col("pending").alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return v.select("path", "blob")

    def join_back(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Adds ``spans``: array of (start, k, end, kind) in listed order; empty where nothing was found."""
        every = F.array(*(F.lit(_name(r)) for r in rules))
        k = (F.array_position(every, F.col("rule")) - 1).cast("int")
        spans = (
            self.findings().withColumn("k", k).where("k >= 0").distinct()
            .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("spans"))
        )
        # Findings have one row a blob; a blob on very many paths makes a skewed join, which AQE splits.
        return paths.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string>>")))


def render(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
