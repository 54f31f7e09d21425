"""A training corpus from the documents table: classify, drop near duplicates, redact secrets, mix, pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and rereads as the next stage's docs. All but the last return the columns of documents. A classifier is trained
in the first stage and packing cuts token ids, so no SQL gives run()'s rows; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.llm import cotraining, ffd_packing, lsh_forest, mixing, ownership_secrets
from echoloom.llm.common import materialize


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return cotraining.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return lsh_forest.without_duplicates(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return ownership_secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each pass over a document, cut to the words the mix takes."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024."""
    return ffd_packing.pack(docs)


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", deduplicated),
    ("secret scans", redacted),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Training, min-hashing and tokenizing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
