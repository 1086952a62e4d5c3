"""Bounded samples of labelled rows for the classifiers, and the fold rule that keeps held-out rows away from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most: the first ones in the order of a seeded hash.
FIT_ROWS = 12_000
#: Bytes of text among them at most: a text that would pass it is left out, and the next ones are tried.
FIT_BYTES = 48_000_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most `rows` labelled, not held-out rows; repeatable, by hash of doc_id.

    The ids are chosen on the labels alone, so that texts of other rows aren't shuffled."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(f"doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    ids = [tuple(r) for r in chosen.collect()]  # at most `rows`
    if not ids:
        return [], []
    small = F.broadcast(spark.createDataFrame(ids, "doc_id long, y int"))  # at most `rows` rows of 12 bytes
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small, "doc_id")
    texts, ys, used = [], [], 0
    for r in got.withColumn("o", F.xxhash64(F.lit(11), "doc_id")).orderBy("o", "doc_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if used + n > size:
            continue
        used += n
        texts.append(r["text"])
        ys.append(r["y"])
    return texts, ys
