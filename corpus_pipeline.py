"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, personal data, tokens.

Every stage takes the documents its predecessor kept, written as Parquet and read again, and returns a
DataFrame: the columns of documents, but for the last stage, which returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigraph.llm import bpe, decontam, jaccard, pii, quality
from verdigraph.llm.common import scratch
from verdigraph.llm.queries import BYTE_BPE, table

# Models are fitted and near duplicates linked by Spark jobs; SQL cannot express the stages.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to have quality label 1."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the document with the least doc_id."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte-level bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:  # what a stage stored on its way goes once its output is written
            docs = keep(stage(spark, docs, sf_dir), f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
