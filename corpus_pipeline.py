"""A training corpus from raw documents: quality, near duplicates, personal data, source mix, tokens.

Each stage takes what the one before kept and returns the columns of documents; the last returns digests of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexipulse.llm import bpe, jaccard, mixing, pii, quality
from lexipulse.llm.queries import VOCABULARY
from lexipulse.llm.workspace import dropped, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their language's perplexity band reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle similarity 0.8 or more, the row of smallest doc_id stays."""
    return jaccard.without_near_duplicates(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat, twice at most; every document is there at least once."""
    return mixing.mixed(docs, repeats=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row."""
    return bpe.bpe_digests(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]

#: Perplexity, components and BPE have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, and deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
