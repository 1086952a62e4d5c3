"""Operator 2: near duplicates by ProbMinHash over weighted word shingles.

Signature. Every distinct shingle of a text, weighted 1 + ln(count), is a Poisson process of that rate whose arrivals
fall into one of REGISTERS registers; a register keeps the shingle that arrives first. Arrivals of a shingle end as soon
as its next one is later than the latest register of the text. Two registers agree with the probability Jaccard
similarity of the two weighted sets. Arrival j of a shingle depends on its hash and j alone, so that batches don't matter.
A text that repeats shingles has a second signature of the set alone (all weights 1), which estimates the Jaccard
similarity; elsewhere the two are the same.

Candidates. Equal texts are collapsed first. BANDS bands of registers of either signature put texts into buckets. Buckets of
at most BUCKET texts form all their pairs. In larger buckets each text meets the LEADERS texts that are most like the
bucket. Pairs whose registers agree too seldom in both signatures are dropped.

Verification. A pair is a link if the exact similarity of the 5-word shingles is at least `threshold`: the greater one of
the Jaccard similarity of the sets and the probability Jaccard similarity of the weighted sets (both agree where no
shingle repeats). Classes are the connected components of links; components are found by star contraction in Spark.

The rest of the large buckets. Where texts of a large bucket are still in different classes, all texts outside its
commonest class are compared exactly with all of other classes, in blocks of bounded size, and what is linked is joined.
So no two texts with a link in any bucket end in different classes, links inside a class aren't written, and a family of
any size costs as much as its members, not their pairs; only texts that share a band without being alike cost pairs.

Words are runs of other than ASCII white space in lower case; a text of fewer than five words is one shingle; null counts
as the empty text, and texts without words are duplicates only of equal texts. Null doc_ids can't be named and keep
a row each in their text's class, named by the class's least doc_id (null where it has none). Repeated rows
stay rows. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowered, mix, shingle_hashes, staged, texts_of, unstage, utf8_buffer, word_hashes

WORDS, THRESHOLD = 5, 0.8
REGISTERS, BANDS = 128, 32
#: Buckets of at most so many texts form their pairs in Spark; larger ones have so many leaders first.
BUCKET, LEADERS = 48, 4
#: Texts and bytes of text in a block, about.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Pairs whose registers agree less than the threshold by this much, in either measure, can't be links but with odds below 1e-7.
SLACK = 0.2


def weighted(body: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a lower-case text, ascending, and their counts."""
    return np.unique(shingle_hashes(word_hashes(body), words), return_counts=True)


def _arrivals(h: np.ndarray, rate: np.ndarray, j: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time before arrival j of each shingle, and the register it falls into."""
    r = mix(h ^ mix((j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(u) / rate, (mix(r + np.uint64(0xA0761D6478BD642F)) >> np.uint64(17)).astype(np.int64) % registers


def signature(h: np.ndarray, rate: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register, as 16 bits of its hash."""
    at = np.full(registers, np.inf)
    who = np.zeros(registers, np.uint64)
    now, j = np.zeros(len(h)), 0
    while len(h):
        step = max(1, min(256, 2 * registers // len(h)))
        gap, reg = _arrivals(np.repeat(h, step), np.repeat(rate, step), np.tile(np.arange(j, j + step), len(h)), registers)
        when = (now[:, None] + np.cumsum(gap.reshape(-1, step), axis=1)).ravel()
        near = when < at.max()
        t, k, x = when[near], reg[near], np.repeat(h, step)[near]
        np.minimum.at(at, k, t)
        won = at[k] == t
        who[k[won]] = x[won]
        now, j = when[step - 1 :: step], j + step
        alive = now < at.max()
        h, rate, now = h[alive], rate[alive], now[alive]
    return (mix(who) >> np.uint64(48)).astype("<u2")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact Jaccard of the sets and probability Jaccard of the weighted sets, each (shingles, counts)."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(ia)
    plain = len(ia) / union
    if ca.max() == 1 and cb.max() == 1:
        return plain, plain
    x, y = 1 + np.log(ca), 1 + np.log(cb)
    only_a, only_b = x.sum() - x[ia].sum(), y.sum() - y[ib].sum()
    x, y = x[ia], y[ib]
    # sum over j of max(x_j/x_i, y_j/y_i): with r = x/y, the first is larger where r_j > r_i
    r = x / y
    by = np.argsort(r)
    xs, ys = x[by], y[by]
    above = np.append(np.cumsum(xs[::-1])[::-1], 0.0)
    below = np.concatenate(([0.0], np.cumsum(ys)))
    i = np.arange(len(r))
    return plain, float((1.0 / ((above[i] + only_a) / xs + (below[i] + only_b) / ys)).sum())


def prob_sign(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return signature(h, 1 + np.log(counts))


def signatures(docs: DataFrame, words: int = WORDS, sign: Callable[[np.ndarray, np.ndarray], np.ndarray] = prob_sign) -> DataFrame:
    """doc_id, h (SHA-256 of the text), sig (REGISTERS x 16 bits, null without words) and plain (that of the set alone, null
    where it is sig) for docs (doc_id, text), in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts_of(batch)
            raw, at = utf8_buffer(text)
            body, off = utf8_buffer(lowered(text))
            hs, sigs, plains = [], [], []
            for i in range(len(text)):
                hs.append(hashlib.sha256(raw[at[i] : at[i + 1]]).digest())
                h, c = weighted(body[off[i] : off[i + 1]], words)
                sigs.append(sign(h, c).tobytes() if len(h) else None)
                plain = sign(h, np.ones_like(c)).tobytes() if len(h) and c.max() > 1 else None
                plains.append(plain if plain != sigs[-1] else None)
            cols = [batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in (hs, sigs, plains))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "sig", "plain"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary, sig binary, plain binary")


def candidates(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) that share a bucket of at most BUCKET texts; rows (rep, key, size) of the larger buckets."""
    width = 2 * REGISTERS // BANDS
    bands = lambda sig: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(sig, b * width + 1, width)).alias("key")))
    either = F.when(F.col("plain").isNull(), bands("sig")).otherwise(F.array_union(bands("sig"), bands("plain")))
    rows = sigs.select("rep", F.explode(F.transform(either, lambda s: s["key"])).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # lists are made of small buckets alone
    small = rows.join(sizes.where(F.col("size") <= BUCKET).hint("shuffle_merge"), "key").groupBy("key").agg(F.collect_set("rep").alias("reps"))
    pairs = F.expr("flatten(transform(reps, (x, i) -> transform(slice(reps, i + 2, size(reps)), y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")
    found = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    large = rows.join(sizes.where(F.col("size") > BUCKET).hint("shuffle_merge"), "key").select("rep", "key", "size")
    return found, large


def medoids(block: pa.Table, most: int) -> list[tuple[int, float]]:
    """Of the texts of a block (rep, sig), those whose registers agree most with the block's commonest ones, and that share."""
    rep = block["rep"].to_numpy()
    sig = np.frombuffer(b"".join(block["sig"].to_pylist()), "<u2").reshape(len(rep), REGISTERS)
    common = np.empty(REGISTERS, sig.dtype)
    for i in range(REGISTERS):
        kinds, n = np.unique(sig[:, i], return_counts=True)
        common[i] = kinds[np.argmax(n)]
    share = (sig == common).mean(axis=1)
    best = np.lexsort((rep, -share))[:most]
    return list(zip(rep[best].tolist(), share[best].tolist()))


def block_links(block: pa.Table, threshold: float, words: int = WORDS) -> list[tuple[int, int]]:
    """Links (a < b) between the classes of two blocks of a bucket (rep, class, own, i, j, text), or of one where i = j.

    Every two texts of different classes are compared exactly; a link joins their classes for the rest of the block, so
    the links that come out connect whatever any link connects."""
    block = block.combine_chunks()
    rep, own, label = block["rep"].to_numpy(), block["own"].to_numpy(), block["class"].to_numpy().copy()
    across = block["i"][0].as_py() != block["j"][0].as_py()
    body, off = utf8_buffer(lowered(block["text"].combine_chunks()))
    sets = [weighted(body[off[i] : off[i + 1]], words) for i in range(len(rep))]
    size = np.array([len(h) for h, _ in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    kinds, ids = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    rate = np.concatenate([1 + np.log(c) for _, c in sets])
    share = rate / np.repeat(np.add.reduceat(rate, at[:-1]), size)
    repeats = np.array([c.max() > 1 for _, c in sets])
    mine, weight = np.zeros(len(kinds), bool), np.zeros(len(kinds))
    found = []
    for x in range(len(rep) - 1):
        other = label[x + 1 :] != label[x]
        if across:
            other &= own[x + 1 :] != own[x]
        if not other.any():
            continue
        here, tail, starts = ids[at[x] : at[x + 1]], ids[at[x + 1] :], at[x + 1 : -1] - at[x + 1]
        mine[here] = True
        both = np.add.reduceat(mine[tail], starts, dtype=np.int64)
        mine[here] = False
        link = both / (size[x] + size[x + 1 :] - both) >= threshold
        rest = ~link & other & (repeats[x] | repeats[x + 1 :])
        if rest.any():
            # the shares that both have are never less than the probability Jaccard similarity
            weight[here] = share[at[x] : at[x + 1]]
            rest &= np.add.reduceat(np.minimum(weight[tail], share[at[x + 1] :]), starts) >= threshold - 1e-9
            weight[here] = 0
            for y in np.flatnonzero(rest):
                link[y] = similarity(sets[x], sets[x + 1 + y])[1] >= threshold
        joined, first = np.unique(label[x + 1 :][link & other], return_index=True)
        hits = np.flatnonzero(link & other)[first] + x + 1
        found += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in hits]
        label[np.isin(label, joined)] = label[x]
    return found


def star_pairs(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a < b) of each text in large buckets with the leaders of the largest one that holds it.

    Leaders are the texts most like their bucket, so the original of a family is one wherever it lies. A task looks at
    the registers of one block of a bucket."""

    def run(block: pa.Table) -> pa.Table:
        best = medoids(block, LEADERS)
        return pa.table({"key": pa.array([block["key"][0].as_py()] * len(best), pa.int64()), "lead": pa.array([r for r, _ in best], pa.int64()), "share": pa.array([s for _, s in best], pa.float64())})

    home = large.groupBy("rep").agg(F.max(F.struct("size", "key")).alias("at")).select("rep", "at.key", "at.size")
    cut = home.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)).cast("int"))
    best = cut.join(sigs.select("rep", "sig"), "rep").select("key", "block", "rep", "sig").groupBy("key", "block").applyInArrow(run, "key long, lead long, share double")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("share"), "lead"))).where(F.col("rank") <= LEADERS)
    pairs = home.select("rep", "key").join(best.select("key", "lead"), "key").where("rep != lead")
    return pairs.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))


def open_links(spark: SparkSession, large: DataFrame, roots: DataFrame, bodies: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """The links (a, b) between classes that share a large bucket, as far as they are needed to join the classes.

    Of each bucket with texts of more than one class (node, root), all texts outside its commonest class are compared
    with all texts of other classes, in blocks of bounded size."""

    def run(block: pa.Table) -> pa.Table:
        found = block_links(block, threshold, words)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    known = large.select("rep", "key").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("root", "rep").alias("class"))
    known = staged(spark, known.join(bodies.select("rep", F.octet_length("text").alias("bytes")), "rep"), "classed")
    per = known.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    kinds = per.groupBy("key").agg(F.max(F.struct("n", "class", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("main.n < n")
    kinds = kinds.select("key", F.col("main.class").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("few"), blocks(F.col("main.n"), F.col("main.bytes")).alias("many"))
    own = known.join(kinds, "key").withColumn("own", F.when(F.col("class") == F.col("main"), F.col("few") + F.pmod(F.xxhash64("rep"), F.col("many"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("few"))).cast("int"))
    meets = F.when(F.col("own") < F.col("few"), F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    each = own.select("rep", "key", "class", "own", F.explode(meets).alias("other"))
    each = each.select("rep", "key", "class", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return each.join(bodies, "rep").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs of which enough registers agree, in one signature or the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sig", "sig2", "plain", "plain2"))
                keep = np.maximum((x == y).mean(axis=1), (p == q).mean(axis=1)) >= threshold - SLACK
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    s = sigs.select("rep", "sig", "plain")
    both = pairs.join(s.withColumnRenamed("rep", "a"), "a").join(s.toDF("b", "sig2", "plain2"), "b")
    wide = both.select("a", "b", "sig", "sig2", F.coalesce("plain", "sig").alias("plain"), F.coalesce("plain2", "sig2").alias("plain2"))
    return wide.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) that are links, with both similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            (xa, oa), (xb, ob) = utf8_buffer(lowered(batch.column("text"))), utf8_buffer(lowered(batch.column("text2")))
            rows = []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], weighted(xa[oa[i] : oa[i + 1]], words)
                plain, prob = similarity(mine, weighted(xb[ob[i] : ob[i + 1]], words))
                if max(plain, prob) >= threshold:
                    rows.append((a[i], b[i], plain, prob))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["a", "b", "jaccard", "prob_jaccard"])

    # only texts in pairs travel
    t = texts.select("rep", "text")
    wide = pairs.join(t.withColumnRenamed("rep", "b").withColumnRenamed("text", "text2"), "b").join(t.withColumnRenamed("rep", "a"), "a")
    return wide.select("a", "b", "text", "text2").mapInArrow(run, "a long, b long, jaccard double, prob_jaccard double")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, least node of its component, for links (a, b): large-star and small-star steps on staged tables."""
    edges = staged(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, done = None, edges
    while True:  # the number of rounds grows with the logarithm of the nodes
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: greater neighbours of u go to its least neighbour; then small star on the rest
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        last, edges = done, staged(spark, edges, "edges")
        unstage(last)
        done = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots._staged_at = edges._staged_at
            return roots
        before = now


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, sign: Callable[[np.ndarray, np.ndarray], np.ndarray] = prob_sign) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id (least doc_id of its class), class_texts (different texts in it),
    keep (true for one row of each class), text_sha256."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(spark, signatures(d, words, sign).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # one row a text; rep names it
    texts = rows.groupBy("h").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.any_value("sig").alias("sig"), F.any_value("plain").alias("plain"))
    texts = staged(spark, texts, "texts")
    sigs = texts.where("sig IS NOT NULL").select("rep", "sig", "plain")
    found, large = candidates(sigs)
    large = staged(spark, large, "large")
    pairs = staged(spark, _agreeing(found.union(star_pairs(large, sigs)).distinct(), sigs, threshold), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
    wanted = texts.join(paired, "rep").select("h", "low", "rep")
    named = d.withColumn("h", F.unhex(F.sha2("text", 256))).withColumnRenamed("doc_id", "low")
    # a text's rows share h; those of its least doc_id are the same row again
    bodies = named.join(wanted, (named["h"] == wanted["h"]) & named["low"].eqNullSafe(wanted["low"])).select("rep", "text")
    bodies = staged(spark, bodies.groupBy("rep").agg(F.any_value("text").alias("text")), "bodies")
    links = staged(spark, verified(pairs, bodies, threshold, words).select("a", "b"), "links")
    roots = components(spark, links)
    more = staged(spark, open_links(spark, large, roots, bodies, threshold, words).distinct(), "more")
    if not more.isEmpty():
        roots, old = components(spark, links.union(more)), roots
        unstage(old)
    unstage(large, pairs, bodies, links, more)
    grouped = texts.select("h", "low", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h", "low", F.coalesce("root", "rep").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("class_id"), F.count("*").alias("class_texts"))
    classes = grouped.select("h", "root").join(least, "root")
    out = rows.select("doc_id", "h", "row").join(classes, "h")
    first = out.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("row"))
    kept = first.select("row", F.lit(True).alias("keep"))
    return out.join(kept, "row", "left").select("doc_id", "class_id", "class_texts", F.coalesce("keep", F.lit(False)).alias("keep"), F.hex("h").alias("text_sha256"))
