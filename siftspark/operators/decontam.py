"""Benchmark contamination: windows of words that a reference has, too."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConfigError
from ..functions.text import in_slices
from ..workspace import staged

_SPLIT = re.compile(r"[\W_]+")
#: Bytes of hashes of reference windows (8 each) up to which every worker gets them.
BROADCAST_BYTES = 64 << 20

REGISTRY: dict[str, tuple[str, list[tuple[str, str]], list[str]]] = {
    "arc": ("allenai/ai2_arc", [("ARC-Easy", "test"), ("ARC-Challenge", "test")], ["question"]),
    "gsm8k": ("openai/gsm8k", [("main", "test")], ["question"]),
    "hellaswag": ("Rowan/hellaswag", [("default", "validation")], ["ctx"]),
    "humaneval": ("openai/openai_humaneval", [("openai_humaneval", "test")], ["prompt", "canonical_solution"]),
    "mbpp": ("google-research-datasets/mbpp", [("full", "test")], ["text"]),
    "mmlu": ("cais/mmlu", [("all", "test")], ["question"]),
    "truthfulqa": ("truthfulqa/truthful_qa", [("generation", "validation")], ["question"]),
    "winogrande": ("allenai/winogrande", [("winogrande_xl", "validation")], ["sentence"]),
}


def benchmark_names(names: str | list[str]) -> list[str]:
    """Registry names of a comma list, or all of them."""
    got = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names) if n.strip()]
    if "all" in got:
        return sorted(REGISTRY)
    if bad := [n for n in got if n not in REGISTRY]:
        raise ConfigError(f"unknown benchmarks: {', '.join(bad)}")
    return got


def words_of(text: str) -> list[str]:
    return _SPLIT.sub(" ", text.lower()).split()


#: Non-ASCII characters that end words, and ASCII bytes that do, as spaces.
_ODD, _SPACED = re.compile(r"[^\w\x00-\x7f]+"), bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, 1 << 18), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


class Windows:
    """Hashes of the word windows of several texts, by array operations over their bytes; words as words_of() has them."""

    def __init__(self, texts: list[str]):
        parts = [(t if t.isascii() else _ODD.sub(" ", t)).encode().translate(_SPACED) for t in map(str.lower, texts)]
        self.data = b" ".join(parts)
        body = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.concatenate(([True], body == 32, [True])).view(np.int8))
        self.first, self.last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        #: the number of each word's text
        self.of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), self.first, side="right")
        total = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(body)), out=total[1:])
        h = (total[self.last] - total[self.first]) * _powers(pow(_BASE, -1, 1 << 64), len(body) + 1)[self.first]
        self.words = (h ^ (h >> np.uint64(29))) * _STEP

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the windows of k words, and the windows' hashes."""
        n = max(0, len(self.words) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = (h ^ (h >> np.uint64(31))) * _STEP + self.words[i : i + n]
        at = np.flatnonzero(self.of[:n] == self.of[len(self.of) - n :])
        return at, h[at].view(np.int64)

    def gram(self, at: int, k: int) -> str:
        return " ".join(self.data[self.first[at] : self.last[at + k - 1]].decode().split())


@in_slices(T.LongType())
def _hashes(v: pa.Array) -> pa.Array:
    """The hash of each (k, gram), as Windows has it for a window of these words."""
    w = Windows(v.field("gram").to_pylist())
    out = np.zeros(len(v), np.int64)
    ks = v.field("k").to_numpy(zero_copy_only=False)
    for k in np.unique(ks):
        at, h = w.hashes(int(k))
        mine = ks[w.of[at]] == k
        out[w.of[at[mine]]] = h[mine]
    return pa.array(out)


_GRAMS = pa.list_(pa.struct([("k", pa.int32()), ("gram", pa.string())]))
#: Characters of texts whose windows are hashed at one time; a longer text is alone.
BLOCK = 1 << 17


def windows(sizes: list[int], known=None):
    """A UDF: the windows of each size in a text, as [(k, gram)], repeats kept; with a broadcast table of sorted hashes by size
    only those whose hash is in it."""

    def hit(texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        w = Windows(texts)
        for k in sizes:
            at, h = w.hashes(k)
            table = known.value[k]
            for i in at[table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h].tolist():
                out[w.of[i]].append({"k": k, "gram": w.gram(i, k)})
        return out

    @in_slices("array<struct<k:int,gram:string>>")
    def run(v: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        if known is None:
            for text in v.to_pylist():
                w = words_of(text or "")
                out.append([{"k": k, "gram": " ".join(w[i : i + k])} for k in sizes for i in range(len(w) - k + 1)])
            return pa.array(out, _GRAMS)
        block: list[str] = []
        for text in v.to_pylist():
            block.append(text or "")
            if sum(map(len, block)) >= BLOCK:
                out += hit(block)
                block = []
        return pa.array(out + hit(block) if block else out, _GRAMS)

    return run


def reference_grams(refs: DataFrame, text: str = "text", n: int = 8, min_words: int = 4) -> DataFrame:
    """Distinct (k, gram): all n-word windows of a reference; a shorter one of min_words or more is one gram."""
    if n < 2:
        raise ConfigError("decontam_ngram is 2 or more")

    @in_slices("array<struct<k:int,gram:string>>")
    def run(v: pa.Array) -> pa.Array:
        out = []
        for t in v.to_pylist():
            w = words_of(t or "")
            k = min(n, len(w))
            out.append([{"k": k, "gram": " ".join(w[i : i + k])} for i in range(len(w) - k + 1)] if len(w) >= min_words else [])
        return pa.array(out, _GRAMS)

    return refs.select(F.explode(run(F.col(text))).alias("g")).select("g.k", "g.gram").distinct()


def contamination(docs: DataFrame, key: str, text: str, grams: DataFrame, min_hits: int = 1) -> DataFrame:
    """(key, hits) of the docs with min_hits or more window positions in the references.

    While 8 bytes a reference window are within BROADCAST_BYTES, the workers hold their sorted hashes and only windows
    that hit one leave them, to be compared by the words themselves; beyond that, all windows are joined by shuffle."""
    spark = docs.sparkSession
    grams = staged(spark, grams, "grams")
    counted = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a line a window size
    if not counted:
        raise ConfigError("there is no usable reference")
    known = None
    if 8 * sum(counted.values()) <= BROADCAST_BYTES:
        hashed = grams.select("k", _hashes(F.struct("k", "gram")).alias("h")).toArrow()
        ks, h = hashed["k"].to_numpy(), hashed["h"].to_numpy()
        known = spark.sparkContext.broadcast({k: np.unique(h[ks == k]) for k in counted})
    hit = docs.select(F.col(f"`{key}`"), F.explode(windows(sorted(counted), known)(F.col(f"`{text}`"))).alias("g")).select(f"`{key}`", "g.k", "g.gram")
    return hit.join(grams, ["k", "gram"]).groupBy(key).agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
