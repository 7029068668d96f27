"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, packing."""
from tidewell.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
