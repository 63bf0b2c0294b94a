"""From raw documents to packed training batches, one written stage after the other.

Each stage takes the documents its predecessor kept and returns those it keeps,
with the columns of the table; the last deals them into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridsmith.llm import exact_dedup, language, packing, simhash, toxicity
from gridsmith.session import scratch_folder


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by the nearest labelled ones.

    A decision holds for all rows of one key and text, NULL keys too; NULL and
    empty texts are scored like any other. An empty table gives no rows, and
    other columns may have any names: that holds for every stage.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(toxicity.trains())
    return toxicity.drop_toxic(docs, labels)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the ``lang`` column teaches; texts without a letter, NULL and empty ones too, go."""
    return language.drop_unknown(docs, docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest key; of rows alike in key and text one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest key, NULL behind all others; repeated rows stay together.

    Near copies have SimHash fingerprints that link, as in ``op10_simhash``, or at least 0.8 of their shingles in common.
    """
    return simhash.drop_near_copies(docs, radius=simhash.RADIUS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in a batch of its length bucket; every row has its own place, whatever its key and text."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter), ("language", language_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", batches),
]
#: SQL has neither the classifiers nor the fingerprints of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        folder = scratch_folder(spark)
        kept.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
