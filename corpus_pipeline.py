"""A training-data pipeline over ``documents``: five stages, each one operator of ``deedscope.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes as
Parquet and reads again as the next stage's documents. A stage works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedscope.llm import boosted_quality
from deedscope.llm.byte_bpe import round_trip
from deedscope.llm.common import documents, labels
from deedscope.llm.line_dedup import deduplicate_lines
from deedscope.llm.mixing import mix
from deedscope.llm.ngram_join import drop_near_duplicates
from deedscope.plans.lineage import scratch_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for good."""
    return boosted_quality.keep_good(docs, labels(spark, sf_dir)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted, and documents of which no word is left."""
    cleaned = deduplicate_lines(docs)
    gone = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.filter(~gone | F.col("text").isNull())
    changed = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their sources' target weights ask, in a random order."""
    return mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests of its ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("byte-level BPE", tokens),
]

# Neither trained trees, nor prefix doubling, nor a randomised join can be put in SQL; the stages
# are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what lies between two of them is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, scratch_path(spark, "pipeline"))
    return docs
