"""The thin queries opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_content, media, mixing, packing, probminhash, quality, secret_scan, token_shards, toxicity
from .common import documents, table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(spark, documents(spark, sf_dir))


def op2_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(spark, documents(spark, sf_dir))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(spark, docs, *quality.model(spark, docs, table(spark, sf_dir, "labels")))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, documents(spark, sf_dir))


def op5_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(spark, documents(spark, sf_dir))


def op7_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, documents(spark, sf_dir))


def op8_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spark, documents(spark, sf_dir))


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, *toxicity.model(spark, docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be said in SQL whole; tests/llm holds them against brute force."""
    return {}
