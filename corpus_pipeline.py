"""A training corpus from `documents`: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm import stages
from siftspark.llm.common import staged

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_copies),
    ("secrets", stages.redact_secrets),
    ("mixing", stages.mix_by_weight),
    ("packing", stages.pack_sequences),
]

#: SQL can't express the fitted lexicon, the verified classes or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows that the one before it kept, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(spark, docs, name)
    return docs
