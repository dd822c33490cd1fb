"""A training-data pipeline over the table documents, from the operators of captionlake.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.common import table, written
from captionlake.llm.fm import fit_on_labels, score_documents
from captionlake.llm.hyperminhash import keep_one
from captionlake.llm.packing import pack_documents
from captionlake.llm.pii import replace_entities
from captionlake.llm.queries import PII_KEY
from captionlake.llm.repeats import remove_repeats

#: Documents that score less are rejected.
LEAST_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).filter(F.col("score") >= LEAST_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return keep_one(docs, width=5, threshold=80).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every byte that 200-byte strings with another occurrence cover. Documents stay, if need be with an empty text."""
    out = remove_repeats(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by surrogates."""
    return replace_entities(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
