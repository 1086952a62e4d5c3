"""Operator 6: MinHash fingerprints under universal hash permutations, banded and joined in Spark, verified by Jaccard.

A fingerprint is, for each of PERMUTATIONS functions x -> a*x + b mod 2^32 (a odd), the least value over the hashed
5-word shingles of the lower-case text, kept as 16 bits of its mix; all are computed at once in numpy blocks. The share of
equal entries estimates the Jaccard similarity.

Nulls and edges: a null text counts as empty; texts without words share one fingerprint and are alike (1.0) to each
other and unlike (0.0) any other; a text of fewer than five words is one shingle. Rows go in descending doc_id, equal
doc_ids by text, null doc_ids last. The last row is followed by the first one (a single row by itself). Repeated rows are
kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import probminhash
from .common import mix, parts_for, range_bounds, range_bucket, shingle_hashes, word_hashes

PERMUTATIONS = probminhash.REGISTERS
BLOCK = 4096
#: Documents that one task should follow in order.
RANGE_DOCS = 4096

_G = np.random.default_rng(20240607)
_A = (_G.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _G.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of hashed shingles (64 bits each): PERMUTATIONS integers of 16 bits."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), BLOCK):
        np.minimum(low, (_A * x[None, i : i + BLOCK] + _B).min(axis=1), out=low)
    return (mix(low.astype(np.uint64) + np.uint64(len(x) > 0)) >> np.uint64(48)).astype("<u2")


def fingerprint(text: str, words: int = 5) -> np.ndarray:
    return minhash(shingle_hashes(word_hashes(np.frombuffer(text.lower().encode(), np.uint8)), words))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(spark: SparkSession, docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Fingerprints of each text, of its edit by the next text in descending doc_id, and their likeness.

    Texts are shuffled once, by ranges of doc_id. The first row of each range goes to the range before it, too."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = d.count()
    bounds = range_bounds(d.withColumn("down", -F.col("doc_id")), "down", parts_for(spark, rows, range_docs))
    down = -F.col("doc_id")
    n = len(bounds) + 1
    ends = d.agg(F.max("doc_id"), F.count("doc_id")).first()
    bucket = F.when(F.col("doc_id").isNull(), F.lit(n - 1)).otherwise(range_bucket(down, bounds))
    # a bound is a doc_id that exists: the first of its range; the greatest doc_id also follows the last row
    starts = [i for i in bounds] if bounds else []
    is_start = down.isin(starts) if starts else F.lit(False)
    top = F.col("doc_id").eqNullSafe(F.lit(ends[0]).cast("long"))
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("guest"))
    before = F.when(is_start, F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("guest")))
    last = F.when(top, F.struct(F.lit(n - 1).alias("bucket"), F.lit(1).alias("guest")))
    placed = d.select("doc_id", "text", F.explode(F.array_compact(F.array(own, before, last))).alias("p")).select("doc_id", "text", "p.bucket", "p.guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False
        for batch in batches:
            out = []
            for doc, text, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("guest").to_pylist()):
                text = text.as_py()
                if over:
                    continue
                mine = fingerprint(text)
                if held is not None:
                    out.append(_row(*held, text, mine))
                held, over = (doc, text, mine), bool(guest)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return placed.repartitionById(n, F.col("bucket")).sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), "text").select("doc_id", "text", "guest").mapInArrow(run, OUT)


def _row(doc: int | None, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> dict:
    new = edited(text, following)
    other = fingerprint(new)
    return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": mine.tobytes().hex(), "edited_fingerprint": other.tobytes().hex(), "near_edited": likeness(mine, other), "near_next": likeness(mine, theirs)}


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = probminhash.THRESHOLD) -> DataFrame:
    """Classes of near copies by these fingerprints: banded, joined and verified as in operator 2, whose edges cases hold."""
    return probminhash.near_duplicates(spark, docs, threshold, sign=lambda h, c: minhash(h))
