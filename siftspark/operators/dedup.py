"""Deduplication: exact by record hash (with durable state), fuzzy by MinHash bands, semantic by hyperplane bands.

All keep the first record in the order of a unique `order` column. Fuzzy and semantic dedup compare with kept records
alone, so a record that only resembles a dropped one stays: the rounds below repeat that greedy rule without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import SPACES, map_strings, strip
from ..workspace import staged

PERMUTATIONS = 128
PRIME = (1 << 61) - 1


def record_hash(df: DataFrame, fields: list[str] | None = None, normalize: bool = False, leave: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the record's (or the fields') JSON with sorted keys; nulls count, missing fields are null."""
    names = sorted(fields or [c for c in df.columns if c not in leave])
    norm = lambda c: F.regexp_replace(strip(F.lower(c)), f"{SPACES}+", " ")
    cols = []
    for n in names:
        c = F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
        if normalize and n in df.columns:
            c = map_strings(c, df.schema[n].dataType, norm)
        cols.append(c.alias(n))
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def exact_dedup(df: DataFrame, order: str, key: Column) -> DataFrame:
    """The first row of each key. Only ranks 1 leave the map side (window group limit); no row is picked at random."""
    d = df.withColumn("__key", key).withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy(order)))
    return d.where("__rank = 1").drop("__key", "__rank")


def copies(df: DataFrame, order: str, key: Column) -> DataFrame:
    """The `order` values that exact_dedup leaves out."""
    d = df.select(order, key.alias("__key")).withColumn("__rank", F.row_number().over(Window.partitionBy("__key").orderBy(order)))
    return d.where("__rank > 1").select(order)


def durable_dedup(spark: SparkSession, df: DataFrame, order: str, key: Column, state: str) -> tuple[DataFrame, DataFrame]:
    """exact_dedup that also leaves out keys of earlier runs, which the Parquet folder `state` holds; and this run's keys.

    The keys aren't in the state before commit_keys(): a run that dies before its output is written can be repeated."""
    rows = exact_dedup(df.withColumn("__hash", key), order, F.col("__hash"))
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.schema("__hash string").parquet(state).distinct(), "__hash", "left_anti")
    rows = staged(spark, rows, "fresh")
    return rows.drop("__hash"), rows.select("__hash")


def commit_keys(keys: DataFrame, state: str) -> None:
    """Add the keys of a run whose output is written."""
    keys.write.mode("append").parquet(state)


def bands_for(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows with the least mean of false positive and false negative areas."""
    best, out = None, (1, 1)
    x = (np.arange(2000) + 0.5) / 2000
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            p = 1 - (1 - x**r) ** b
            err = 0.5 * p[x < threshold].sum() + 0.5 * (1 - p[x >= threshold]).sum()
            if best is None or err < best - 1e-9:
                best, out = err, (b, r)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(threshold: float):
    """A UDF: hashes of the MinHash bands of a text's 3-word shingles."""
    bands, rows = bands_for(threshold)
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    @arrow_udf("array<long>")
    def run(v: pa.Array) -> pa.Array:
        import xxhash

        out = []
        for text in v.to_pylist():
            w = (text or "").lower().split()
            grams = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} or {" ".join(w)}
            h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
            low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(h), 2048):
                np.minimum(low, _mix(h[None, i : i + 2048] ^ seeds).min(axis=1), out=low)
            out.append([xxhash.xxh64_intdigest(low[i * rows : (i + 1) * rows].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
        return pa.array(out, pa.list_(pa.int64()))

    return run


def greedy_by_keys(spark: SparkSession, keyed: DataFrame, order: str) -> DataFrame:
    """The `order` values that stay, for rows (order, key): none shares a key with an earlier one that stays.

    A round keeps rows that are first among the undecided in all of their keys, and drops rows behind a kept one. Keys are
    aggregated before the shuffle; no pairs are made."""
    left = staged(spark, keyed.select(F.col(order).alias("o"), "key").distinct(), "keys")
    kept = []
    while True:
        first = left.groupBy("key").agg(F.min("o").alias("f"))
        now = staged(spark, left.join(first, "key").groupBy("o").agg(F.min(F.col("o") == F.col("f")).alias("keep")).where("keep").select("o"), "kept")
        if not now.take(1):
            break
        kept.append(now)
        covered = left.join(now, "o", "left_semi").select("key").distinct()
        gone = left.join(covered, "key", "left_semi").select("o").distinct()
        left = staged(spark, left.join(gone, "o", "left_anti"), "keys")
    out = kept[0] if kept else left.select("o")
    for k in kept[1:]:
        out = out.union(k)
    return out.select(F.col("o").alias(order))


def fuzzy_dedup(spark: SparkSession, df: DataFrame, order: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Rows without an earlier kept row that shares a band; bands are taken as similarity, without verification."""
    keyed = df.select(order, F.posexplode(band_keys(threshold)(F.col(text))).alias("band", "hash")).select(order, F.xxhash64("band", "hash").alias("key"))
    return df.join(greedy_by_keys(spark, keyed, order), order, "left_semi")


def greedy_by_pairs(spark: SparkSession, nodes: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """The `order` values that stay, for pairs (a < b) of rows that resemble each other."""
    edges = staged(spark, pairs.select("a", "b").distinct(), "pairs")
    gone = staged(spark, edges.select(F.col("b").alias("o")).where("false"), "gone")
    while True:
        # of the edges left, a node with no earlier neighbour stays, and its later neighbours go
        free = edges.select(F.col("a").alias("o")).distinct().join(edges.select(F.col("b").alias("o")).distinct(), "o", "left_anti")
        now = staged(spark, edges.join(free.withColumnRenamed("o", "a"), "a", "left_semi").select(F.col("b").alias("o")).distinct(), "gone")
        if not now.take(1):
            break
        gone = gone.union(now)
        dead = now.union(free).distinct()
        edges = staged(spark, edges.join(dead.withColumnRenamed("o", "a"), "a", "left_anti").join(now.withColumnRenamed("o", "b"), "b", "left_anti"), "pairs")
    return nodes.join(gone.withColumnRenamed("o", order), order, "left_anti")


def semantic_pairs(df: DataFrame, order: str, vector: str, threshold: float = 0.9, bits: int = 64, bands: int = 8, block: int = 4096) -> DataFrame:
    """Pairs (a < b) with an equal band of hyperplane signs and a cosine of at least the threshold.

    A bucket is cut into blocks of about `block` vectors by a hash; every two blocks are one task's matrix product, so no
    pair below the threshold is ever a row, and no bucket is one task's."""
    per = bits // bands

    @arrow_udf("struct<unit:array<float>,keys:array<int>>")
    def run(v: pa.Array) -> pa.Array:
        out = []
        planes = {}
        for x in v.to_pylist():
            x = np.array(x or [0.0], np.float32)
            if len(x) not in planes:
                planes[len(x)] = np.random.RandomState(0).randn(len(x), bits).astype(np.float32)
            x = x / max(float(np.linalg.norm(x)), 1e-12)
            signs = (x @ planes[len(x)] > 0).reshape(bands, per)
            out.append({"unit": x.tolist(), "keys": (signs @ (1 << np.arange(per))).tolist()})
        return pa.array(out, pa.struct([("unit", pa.list_(pa.float32())), ("keys", pa.list_(pa.int32()))]))

    def products(t: pa.Table) -> pa.Table:
        o, own, width = t["o"].to_numpy(), t["own"].to_numpy(), t["width"].to_numpy()
        found = []
        for w in np.unique(width):  # vectors of other lengths aren't alike
            at = np.flatnonzero(width == w)
            unit = np.stack(t["unit"].take(at).to_pylist()).astype(np.float64)
            left = at if t["i"][0].as_py() == t["j"][0].as_py() else at[own[at] == t["i"][0].as_py()]
            row = {k: n for n, k in enumerate(at.tolist())}
            for s in range(0, len(left), 512):
                mine = left[s : s + 512]
                near = unit[[row[k] for k in mine.tolist()]] @ unit.T >= threshold
                if len(left) < len(at):
                    near &= (own[at] != own[mine][0])[None, :]
                x, y = np.nonzero(near)
                found.append(np.stack([o[mine[x]], o[at[y]]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    spark = df.sparkSession
    d = df.select(F.col(f"`{order}`").cast("long").alias("o"), run.asNondeterministic()(F.col(f"`{vector}`")).alias("r")).select("o", "r.unit", "r.keys")
    d = staged(spark, d, "units")
    keys = d.select("o", F.posexplode("keys").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = keys.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("o"), F.col("blocks")).cast("int"))
    each = own.select("o", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("o", "band", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    wide = each.join(d.select("o", "unit", F.size("unit").alias("width")), "o")
    return wide.groupBy("band", "key", "i", "j").applyInArrow(products, "a long, b long").distinct()


def semantic_dedup(spark: SparkSession, df: DataFrame, order: str, vector: str, threshold: float = 0.9) -> DataFrame:
    return greedy_by_pairs(spark, df, semantic_pairs(df, order, vector, threshold), order)


