"""The training-data pipeline: five stages over `documents`, each by one numbered operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` stores it as
Parquet and hands the stored table to the next stage. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from sigspan.llm import budget_mix, cross_parse, kneser_ney, pair_index, star_dedup
from sigspan.llm.common import release, stored, table
from sigspan.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any text in a language."""
    return cross_parse.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model of trusted text finds unlikely for their language."""
    return kneser_ney.keep_fluent(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return star_dedup.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return budget_mix.draw(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return pair_index.token_digests(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe_encoding", bpe_encoding),
]

#: no stage can be written in SQL; tests compare the run with its stages' brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # The driver keeps only the stored table. Spark drops a stage's broadcasts and shuffle files when
        # the driver's JVM collects their handles, which it would seldom do by itself.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        release()
    return docs
