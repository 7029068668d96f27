import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, ties, repeats, a very long text and columns named like internal ones."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog\nsecond line here", "a"), (2, None, "a"), (3, "", None), (None, "lost id, one two three four five", "b"),
        (4, "The quick brown fox jumps over the lazy dog\nsecond line here", "b"), (4, "The quick brown fox jumps over the lazy dog\nsecond line here", "b"),
        (5, "  \n\t ", "c"), (6, "word " * 60_000, "c"), (7, "É ünï 日本 🎉 text", None), (8, "short", "a"), (None, None, None),
        (9, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG  \nother", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in ("id", "node", "h", "sig", "n", "u", "v", "blob", "keep", "key", "size", "rank", "class", "range", "o", "th", "shard", "mix", "quality", "score", "deduped", "ld_row", "ld_text", "copy", "mix_key", "nj_key")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
