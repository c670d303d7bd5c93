"""The numbered operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigspan.llm import (
    block_neighbours,
    budget_mix,
    cross_parse,
    filter_audit,
    histogram_shards,
    kneser_ney,
    pair_index,
    rotation_codes,
    star_dedup,
    toxic_dictionaries,
    warc_chunks,
    word_runs,
    wrapper_extract,
)
from sigspan.llm.common import table
from sigspan.llm.oracles import ORACLES  # noqa: F401  the others are tested against brute force

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.shard_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix_sources(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.language_id(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_report(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_dictionaries.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_sharding,
        op3_quality_classifier,
        op4_minhash_near_dedup,
        op5_warc,
        op6_mix_sources,
        op7_language_id,
        op8_bpe,
        op9_nearest_neighbours,
        op10_embedding_near_dedup,
        op11_periodic_runs,
        op12_toxicity,
        op13_filter_audit,
    )
}
