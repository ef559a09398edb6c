"""A training corpus from the documents table: bad documents go, copies go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. No stage needs more than its docs and, for the classifier, the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralex.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from terralex.llm.common import mark, release, small_batches, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, gives THRESHOLD or more."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, that with the smallest doc_id."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more in five-word shingles connect, that with the smallest doc_id."""
    small_batches(spark)
    return ngram_join.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced."""
    small_batches(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The classifier's scores can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has written for itself goes with its docs."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, begin, mark(spark) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
