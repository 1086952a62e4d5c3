"""Operator 3: supervised subword embeddings for document quality.

Every word, every pair of neighbouring words and every run of NGRAMS bytes of a text is hashed to one of BUCKETS vectors;
a pair of equal words is one feature of its own. A document is the mean of its vectors; a softmax over two classes
follows. Vectors and output weights are learnt by stochastic gradient descent in numpy on a bounded sample of labelled
rows that aren't held out (FIT_ROWS, FIT_SIZE). As the output is linear in the mean, scoring needs one number a bucket:
the difference of the two class logits, looked up and averaged over the whole text.

Nulls and edges: a null text counts as empty; a text without features scores by the bias alone; null doc_ids are kept
and not held out; without labelled rows the score is 0.5; repeated rows are kept; an empty table gives no rows; other columns are
ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, texts_of, utf8_buffer, word_hashes
from .labelled import fit_sample, held_out

BUCKETS, DIM, NGRAMS = 1 << 17, 12, (3, 4)
EPOCHS, RATE, SEED = 6, 0.6, 5
FIT_ROWS, FIT_SIZE = 6_000, 20_000_000
THRESHOLD = 0.3
SAME = 1


def features(body: np.ndarray) -> np.ndarray:
    """Buckets of all features of one text (UTF-8 bytes), with repeats."""
    found = []
    words = word_hashes(body)
    if len(words):
        found.append((words >> np.uint64(40)).astype(np.int64))
    if len(words) > 1:
        a, b = words[:-1], words[1:]
        found.append(np.where(a == b, SAME, (mix(a * np.uint64(3) + b) >> np.uint64(40)).astype(np.int64)))
    x = body.astype(np.uint32)
    for n in NGRAMS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) ^ x[i : len(x) - n + 1 + i]
            found.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64))
    return np.concatenate(found) % BUCKETS if found else np.zeros(0, np.int64)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Logit difference of each bucket (float32), and of the bias."""
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = []
    for t in texts:
        f, c = np.unique(features(np.frombuffer(t.encode(), np.uint8)), return_counts=True)
        rows.append((f.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    steps, k = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, c = rows[i]
            lr, k = rate * (1 - k / steps), k + 1
            x = c @ e[f]
            z = w @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ w
            w -= lr * 4 * np.outer(p, x)
            bias -= lr * 0.1 * p
            e[f] -= (lr * 16) * c[:, None] * back[None, :]
    return (e @ (w[1] - w[0])).astype(np.float32), float(bias[1] - bias[0])


def model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    texts, ys = fit_sample(spark, docs, labels, "quality", FIT_ROWS, FIT_SIZE)
    return train(texts, ys) if texts else (np.zeros(BUCKETS, np.float32), 0.0)


def score_text(body: np.ndarray, table: np.ndarray, bias: float) -> float:
    f = features(body)
    z = bias + (float(table[f].mean(dtype=np.float64)) if len(f) else 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(spark: SparkSession, docs: DataFrame, table: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for docs (doc_id, text), in place; the model (BUCKETS floats) is broadcast."""
    shared = spark.sparkContext.broadcast((table, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, b = shared.value
        for batch in batches:
            body, off = utf8_buffer(texts_of(batch))
            s = [score_text(body[off[i] : off[i + 1]], t, b) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
