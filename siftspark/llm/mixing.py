"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment of equal-word blocks.

Sources get targets by weight, at most `most` times their size, the excess shared again by weight. The targets' words are
cut into blocks, which go to sources by the highest quotients target/(2k+1). A block has `block` words, or fewer where
that is more than a FINE-th of the smallest target, so that small sources get their share, too. A source's blocks go to
its shards (about SHARD_DOCS rows each) in the same manner by size, so a shard has an integer quota. Within a shard, the
words of the documents in a seeded order form a ring; a quota takes whole rounds of it and a run of blocks from a seeded
start.

Everything hangs on the rows' content: shard and order are hashes of doc_id and text, and equal rows, which nothing can
tell apart, lie side by side and are counted, not numbered. So neither tasks, files nor the order of rows change the
result: equal tables give equal rows.

A third of all rows may be one source: shards, not sources, are windowed; sizes are summed before any shuffle. A third of
all rows may be copies of one row: they are counted first and dealt in parts of SAME. The driver holds one line a source
(some 100 bytes) and no more: `source` is a dimension of at most some millions of names.

Nulls and edges: null text counts 0 words; null doc_id is kept; null source is a source of its own, after all others;
documents of size 0 take 0; sources of size 0 have target 0; repeated rows are taken each; an empty table gives no rows;
other columns are ignored."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, staged

BLOCK, FINE, SHARD_DOCS, MOST, SEED = 32, 16, 50_000, 3.0, 7
#: Copies of one row that are dealt to a shard together at most.
SAME = 10_000


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients v/(2k+1); ties go to the earlier index.

    Starts from the rounded quotas, gives or takes what is over from a heap of quotients, then settles."""
    v = np.asarray(votes, float)
    out = np.zeros(len(v), np.int64)
    total = v.sum()
    if seats <= 0 or total <= 0:
        return out
    out = np.maximum(0, np.floor(v * (seats / total) + 0.5).astype(np.int64))
    over = int(out.sum()) - seats
    if over > 0:
        heap = [(v[i] / (2 * out[i] - 1), -i) for i in np.flatnonzero(out > 0).tolist()]
        heapq.heapify(heap)
        for _ in range(over):
            _, j = heapq.heappop(heap)
            out[-j] -= 1
            if out[-j]:
                heapq.heappush(heap, (v[-j] / (2 * out[-j] - 1), j))
    elif over < 0:
        heap = [(-v[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(v > 0).tolist()]
        heapq.heapify(heap)
        for _ in range(-over):
            _, j = heapq.heappop(heap)
            out[j] += 1
            heapq.heappush(heap, (-v[j] / (2 * out[j] + 1), j))
    while True:  # the best next quotient must not exceed the worst that holds a seat
        nxt = np.where(v > 0, v / (2 * out + 1), -1.0)
        own = np.where(out > 0, v / np.maximum(1, 2 * out - 1), np.inf)
        a, b = int(np.argmax(nxt)), int(len(own) - 1 - np.argmin(own[::-1]))
        if nxt[a] <= own[b] or a == b:
            return out
        out[a] += 1
        out[b] -= 1


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all sizes by weight; none above `most` times its size, the excess reshared by weight."""
    size, w = np.array(sizes, float), np.array(weights, float)
    cap, full = most * size, np.zeros(len(size), bool)
    out = np.zeros(len(size))
    while True:
        free = ~full
        out = np.where(full, cap, (size.sum() - cap[full].sum()) * w / max(w[free].sum(), 1e-300))
        over = free & (out > cap)
        if not over.any():
            return out.tolist()
        full |= over


def block_of(goals: list[float], block: int = BLOCK) -> int:
    """Words in a block: `block`, or fewer (1 at least) so that the smallest target has FINE of them."""
    some = [g for g in goals if g > 0]
    return max(1, min(block, math.floor(min(some) / FINE))) if some else block


def sized(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, source, size and key (by default a hash of the text) of each row."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))) if key is None else key
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_SPACE)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), key.alias("key"))


def mix_rows(spark: SparkSession, rows: DataFrame, weight=lambda i: 1 + i % 3, block: int = BLOCK, shard_docs: int = SHARD_DOCS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per row of rows (doc_id, source, size, key): these, with source_size, target and taken (words).

    Rows of equal doc_id, source, size and key are copies of one row; `key` tells all others apart."""
    items = staged(spark, rows.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n")), "items")
    per = items.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("n").alias("n")).collect()  # one row a source
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    kinds = "source string, sid int, source_size long, target double, quota long, shards int"
    goal = targets([r["s"] for r in per], [weight(i) for i in range(len(per))], most) if per else []
    block = block_of(goal, block)
    quota = sainte_lague(np.array(goal), round(sum(goal) / block))
    table = spark.createDataFrame([(r["source"], i, r["s"], g, int(q), max(1, math.ceil(r["n"] / shard_docs))) for i, (r, g, q) in enumerate(zip(per, goal, quota))], kinds)

    part = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SAME)))).withColumn("n", F.least(F.lit(SAME).cast("long"), F.col("n") - F.col("part") * SAME))
    r, t = part.alias("r"), table.alias("t")
    one = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    one = one.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "key", "part")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "key", "part"), F.col("shards")).cast("int"))
    held = one.groupBy("sid", "quota", "shard").agg(F.sum(F.col("n") * F.col("size")).alias("shard_size"))

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pdf.assign(blocks=sainte_lague(pdf["shard_size"].to_numpy(), int(pdf["quota"].iloc[0])))[["sid", "shard", "shard_size", "blocks"]]

    given = held.groupBy("sid").applyInPandas(give, "sid int, shard int, shard_size long, blocks long")
    one = one.join(given, ["sid", "shard"])
    ring = Window.partitionBy("sid", "shard").orderBy("order", "doc_id", "key", "size", "part").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("a", F.sum(F.col("n") * F.col("size")).over(ring) - F.col("n") * F.col("size"))
    words = F.least(F.col("blocks") * block, F.floor(F.col("shard_size") * F.lit(most)).cast("long"))
    one = one.withColumn("words", words).withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"))
    one = one.withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))) * block
    one = one.withColumn("from", F.when(F.col("shard_size") > 0, F.pmod(start, F.col("shard_size"))).otherwise(0).cast("long"))
    # each copy has words of its own on the ring
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("a", F.col("a") + F.col("copy") * F.col("size"))
    # the run from..from+rest on the ring, which may pass its end
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), hi) - F.greatest(F.col("a"), lo))
    stop = F.col("from") + F.col("rest")
    partial = over(F.col("from"), F.least(stop, F.col("shard_size"))) + over(F.lit(0), stop - F.col("shard_size"))
    taken = (F.col("rounds") * F.col("size") + partial).cast("long").alias("taken")
    return one.select("doc_id", "source", "size", "key", "source_size", "target", taken)


def mix_sources(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for docs (doc_id, text, source); texts are read once and not shuffled."""
    return mix_rows(spark, sized(docs), **options).select("doc_id", "size", "source_size", "target", "taken")
