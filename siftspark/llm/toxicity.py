"""Operator 10: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and digit or sign substitutions inside words to Latin
letters and every other character to a space, one for one. Entries match at word starts: a whole word or, with `*`, a
prefix. Entries and weights are learnt: log odds of documents with the entry among toxic and other labelled ones, for
the words and the prefixes that are precise and frequent enough, shortest prefixes first, each drawn out as
far as nearly all its documents allow. Equal texts count once. Exception phrases cancel the hits inside
them. The score is a logistic function, fitted on the same rows, of the summed weights and of their share per word.

Nulls and edges: a null text counts as empty; the empty text gets the score of no hits; null doc_ids are kept and not
held out; without labelled rows of both classes the lexicon is SEEDS; repeated rows are kept; an empty table gives no
rows; other columns are ignored by score() and kept by keep_clean()."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_of
from .labelled import fit_sample, held_out

SEEDS = {"idiot": 4.0, "moron": 4.0, "scum": 4.0, "stupid": 3.0, "loser": 3.0, "worthless": 3.0, "disgusting": 3.0, "pathetic": 3.0}
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "idiot proof", "sore loser award")
#: Least toxic documents with an entry (in number and as a share), least share of toxic ones among its documents, lengths of
#: prefixes, and the share of a prefix's documents that a longer one must keep to replace it.
LEAST, LEAST_SHARE, PRECISE, PREFIXES, DRAWN = 4, 0.012, 0.93, range(3, 13), 0.95
THRESHOLD = 0.5

_LOOKS = dict(zip("аеорсухіјѕԁһӏԛԝкмнтвзαοενρτυικχγωβɑɡı", "aeopcyxijsdhlqwkmhtbzaoevptuikxywbagi"))
_SUBST = dict(zip("0134578@$!", "oieastbasi"))


class _Fold(dict):
    """Characters to what they count as, made on first sight."""

    def __missing__(self, c: int) -> str:
        ch = chr(c).lower()
        ch = ch if len(ch) == 1 else ch[0]
        wide = unicodedata.normalize("NFKC", ch)
        ch = wide if len(wide) == 1 else ch
        got = _LOOKS.get(ch) or _SUBST.get(ch) or (ch if ch.isalpha() else " ")
        self[c] = got
        return got


_FOLD = _Fold()


def fold(text: str) -> str:
    """Same length; letters of one script, or spaces."""
    return text.translate(_FOLD)


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Entry -> weight. An entry that ends with * is a prefix."""
    once = dict(zip(texts, toxic))
    n = [len(once) - sum(once.values()), sum(once.values())]
    if not n[0] or not n[1]:
        return dict(SEEDS)
    seen: list[Counter] = [Counter(), Counter()]
    for text, y in once.items():
        words = set(fold(text).split())
        seen[y].update(words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k})
    least = max(LEAST, LEAST_SHARE * n[1])
    often = {e: c for e, c in seen[1].items() if c >= least}
    longer: dict[str, list[str]] = {}
    for e in often:
        if e.endswith("*"):
            longer.setdefault(e[:-2] + "*", []).append(e)
    out: dict[str, float] = {}
    base = n[1] / (n[0] + n[1])
    for e in sorted(often, key=lambda e: (not e.endswith("*"), len(e), e)):
        a, b = often[e], seen[0][e]
        # one document more or less must not decide: the share is also drawn towards the base rate
        if a / (a + b) < PRECISE or (a + base) / (a + b + 1) < PRECISE - 0.1:
            continue
        stem = e.rstrip("*")
        if any(stem[:k] + "*" in out for k in range(1, len(stem) + 1)):
            continue
        if e.endswith("*"):
            while more := [x for x in longer.get(e, ()) if often[x] >= DRAWN * a]:
                e = more[0]
            if any(x.endswith("*") and e.startswith(x[:-1]) for x in out):
                continue
        out[e] = round(math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)), 4)
    return out or dict(SEEDS)


class Matcher:
    """Aho-Corasick over folded text with a space before each word."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for e, w in lexicon.items():
            key = " " + (e[:-1] if e.endswith("*") else e + " ")
            self.auto.add_word(key, (len(key), w))
        for e in exceptions:
            if (key := f" {e} ") not in self.auto:
                self.auto.add_word(key, (len(key), None))
        self.auto.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """Summed weights, their share per word by square root of the length, and hits."""
        body = f" {fold(text)} "
        hits, free = [], []
        for end, (size, w) in self.auto.iter(body):
            (free if w is None else hits).append((end - size + 1, end, w))
        if free:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in free)]
        total = sum(h[2] for h in hits)
        return (total, total / math.sqrt(1 + body.count(" ")), len(hits)) if hits else (0.0, 0.0, 0)


def _x(f: tuple[float, float, int]) -> tuple[float, ...]:
    return (1.0, float(f[2] > 0), math.log1p(max(0.0, f[0])), math.log1p(max(0.0, f[1])))


def fit(texts: list[str], toxic: list[int]) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the coefficients of the logistic function (Newton steps with a small ridge)."""
    lexicon = learn_lexicon(texts, toxic)
    if not 0 < sum(toxic) < len(toxic):
        return lexicon, np.array([-3.0, 3.0, 1.0, 1.0])
    m = Matcher(lexicon)
    x, y = np.array([_x(m.features(t)) for t in texts]), np.array(toxic, float)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 0.1 * beta)
    return lexicon, beta


def scorer(lexicon: dict[str, float], beta: np.ndarray):
    """A function of one text, for use in a worker."""
    m = Matcher(lexicon)

    def score(text: str) -> float:
        z = float(np.dot(_x(m.features(text)), beta))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return score


def model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    return fit(*fit_sample(spark, docs, labels, "toxic"))


def score(docs: DataFrame, lexicon: dict[str, float], beta: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for docs (doc_id, text), in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(lexicon, beta)
        for batch in batches:
            s = [of(t.as_py()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: dict[str, float], beta: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    from pyspark.sql.functions import arrow_udf

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scorer(lexicon, beta)
        for batch in texts:
            yield pa.array([of(t or "") < threshold for t in batch.to_pylist()], pa.bool_())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(arrow_udf(run, "boolean")("text"))
