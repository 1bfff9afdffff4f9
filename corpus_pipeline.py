"""A training-corpus pipeline over ``documents``, counted as part of the llm subpackage.

Each stage reads all rows its predecessor kept, from Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingflow.llm import decontaminate, jaccard, mixing, quality, sharding
from filingflow.llm.common import scratch
from filingflow.session import ship

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the perplexity bands accept."""
    ship(spark)
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    ship(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says."""
    ship(spark)
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with the shard of each row; copies of a document share its key and so its shard."""
    ship(spark)
    return sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The language model and the classifier are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
