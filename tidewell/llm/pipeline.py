"""The corpus pipeline: what of ``documents`` is kept, in what shape, and packed.

Every stage takes all rows its predecessor kept, as Parquet written and read
again. All but the last return the columns of their input; the last returns the
packed pieces.

Rows that repeat after mixing are packed each, so a document taken twice has
its pieces twice.

Defined cases, alike in every stage: null text is treated as empty (and stays
null, unless a stage writes texts and its lines change); a null id is kept as a
document of its own; very long texts are read whole; ties go by the smallest id,
then by the text; rows that repeat are decided alike, but of near duplicates,
repeated rows included, one stays; an empty table gives an empty table; columns
of other names, whatever they are, pass through untouched (packing returns its
own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import linededup, mixing, ngramjoin, packing, quality
from tidewell.llm.workdir import materialise, scope

#: The classifier and the packing plan aren't SQL; the tests compare every stage's rows with plain Python.
ORACLE_SQL = None


#: A stage's scratch tables go when the next stage begins, since by then its rows are written out.
_RUN = "pipeline"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. Empty and null texts are scored like others."""
    with scope(spark, _RUN):
        model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        scored, name = quality.classify(docs, model)
        return scored.where(F.col(name)["predicted"] == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; ``n_chars`` follows the text where lines went.

    A document without lost lines keeps its row as it is, a null text included.
    """
    with scope(spark, _RUN):
        deduped, name = linededup.dedup(docs)
        result = F.col(name)
        lost = result["n_dropped"] > 0
        new = {"text": F.when(lost, result["text"]).otherwise(F.col("text"))}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(lost, F.length(result["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return deduped.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Texts without words all stay."""
    with scope(spark, _RUN):
        return ngramjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight. A null source is one source; sources without words go."""
    with scope(spark, _RUN):
        return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048; an empty or null text is the end token alone."""
    import public_tokenizers

    with scope(spark, _RUN):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
