"""Operators 10, 2, 5, 7 and 4 as steps over the documents table: what each decides takes effect on whole rows.

Every step takes docs with doc_id, text and source and keeps all their columns; names of helper columns avoid those that
docs has. Null texts count as empty, null doc_ids and sources are values of their own, an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, probminhash, secret_scan, toxicity
from .common import free_names, table

THRESHOLD = probminhash.THRESHOLD


def _row_key(*parts: str | Column) -> Column:
    """One digest of several values, nulls included, that is never null."""
    return F.sha2(F.to_json(F.struct(*[(F.col(p) if isinstance(p, str) else p).cast("string").alias(f"c{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def _text_hash() -> Column:
    return F.upper(F.sha2(F.coalesce("text", F.lit("")), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the lexicon, learnt from `labels`, doesn't reject. Null and empty texts stay; repeated rows are
    judged alike."""
    return toxicity.keep_clean(docs, *toxicity.model(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (the least doc_id's). Of rows with equal doc_id and text one stays; null and
    empty texts are one class."""
    (k,) = free_names(docs, "k")
    kept = probminhash.near_duplicates(spark, docs, THRESHOLD).where("keep").select(_row_key("doc_id", "text_sha256").alias(k))
    rows = docs.withColumn(k, _row_key("doc_id", _text_hash()))
    # the join and the aggregate share one partitioning, so texts move once
    return rows.join(kept, k).dropDuplicates([k]).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced and n_chars (where there is one) that of the new text; a null text stays null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, each as often as the mix takes its words (rounded); rows of equal doc_id, source and text count as one
    whose copies add up. A run of the ring cuts two documents a shard at most, so a source misses its words by no more
    than half of each of those. Rows without words aren't taken."""
    k, n, copy = free_names(docs, "k", "n", "copy")
    key = _row_key("doc_id", "source", _text_hash())
    mixed = mixing.mix_rows(spark, mixing.sized(docs, key)).where("taken > 0")
    times = mixed.groupBy(F.col("key").alias(k)).agg(F.round(F.sum("taken") / F.max("size")).cast("int").alias(n)).where(F.col(n) > 0)
    once = docs.withColumn(k, key).join(times, k).dropDuplicates([k])
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per piece its place in a sequence of at most 4096 tokens. A null or empty text is one piece of its end id; repeated
    rows are packed each."""
    return packing.pack_documents(spark, docs)
