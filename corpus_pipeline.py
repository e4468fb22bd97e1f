"""The corpus pipeline: quality, language, exact and near copies, then packing into windows.

Each stage is one operator of ``tallymill.llm``; what it returns is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import exact_dedup, hd_language, packing, parity_join, scratch, weak_quality
from tallymill.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality classifier keeps."""
    ship(spark)
    return weak_quality.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus itself names."""
    ship(spark)
    return hd_language.keep(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    ship(spark)
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of n-gram Jaccard links."""
    ship(spark)
    return parity_join.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into windows."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("packing", packed),
]

#: SQL expresses neither the models nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of each stage only its result stays in the shared folder, and only until the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(scratch.made)
    for k, (_, stage) in enumerate(STAGES):
        docs, path = scratch.store(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(spark, *(p for p in list(scratch.made) if p != path and p not in before))
    return docs
