"""Row selection: top percent, sampling, splits, shards, skips. `order` is a unique column that gives the input order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConfigError
from ..workspace import staged


def top_percent(df: DataFrame, score: str, order: str, percent: float) -> DataFrame:
    """The best max(1, round(n * percent / 100)) rows by score, ties by order.

    No task sees all rows or all that stay: the score at the cut is found in a table of distinct scores (aggregated before
    the shuffle), rows above it stay, and of its ties as many as are missing, by rank over sorted ranges."""
    if not 0 < percent <= 100:
        raise ConfigError("keep_top_percent lies above 0, up to 100")
    rank, s = "__rank", F.col(f"`{score}`")
    n = df.count()
    most = max(1, round(n * percent / 100))
    if most >= n:
        return df
    # scores in descending order, counted; nulls come last
    sizes = staged(df.sparkSession, df.groupBy(s.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("s")).withColumn("part", F.spark_partition_id()), "scores")
    parts = [tuple(r) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()]  # one line a range
    before, at = 0, parts[-1][0] if parts else 0
    for part, size in parts:
        if before + size >= most:
            at = part
            break
        before += size
    w = Window.orderBy(F.desc_nulls_last("s")).rowsBetween(Window.unboundedPreceding, -1)  # one range's distinct scores
    cut = sizes.where(F.col("part") == at).withColumn("b", F.coalesce(F.sum("n").over(w), F.lit(0)) + before).where((F.col("b") < most) & (F.col("b") + F.col("n") >= most)).first()
    level, missing = cut["s"], most - cut["b"]
    if level is None:
        above, ties = s.isNotNull(), s.isNull()
    else:
        above, ties = s > F.lit(level), s == F.lit(level)
    some = df.where(ties) if missing >= cut["n"] else with_rank(df.where(ties), order, rank).where(F.col(rank) < missing).drop(rank)
    return df.where(above).unionByName(some)


def unit(order: str, seed: int) -> Column:
    """A repeatable draw in [0, 1) per row that no partitioning changes: the first 52 bits of MD5('seed:order')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{order}`").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample(df: DataFrame, order: str, share: float, seed: int = 0) -> DataFrame:
    return df.where(unit(order, seed) < share)


def parse_split(spec: str) -> list[tuple[str, float]]:
    """'train=0.9,test=0.1': two or more unique names, ratios that sum to 1."""
    out = []
    for part in spec.split(","):
        name, _, ratio = part.partition("=")
        name = name.strip()
        try:
            r = float(ratio)
        except ValueError:
            raise ConfigError(f"no ratio in {part!r}") from None
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name) or not 0 < r <= 1:
            raise ConfigError(f"bad split {part!r}")
        out.append((name, r))
    if len(out) < 2 or len({n for n, _ in out}) < len(out) or abs(sum(r for _, r in out) - 1) > 1e-6:
        raise ConfigError("a split has two or more different names whose ratios sum to 1")
    return out


def split(df: DataFrame, order: str, spec: str, seed: int = 0) -> DataFrame:
    """Adds _split: each row falls into one part."""
    parts, edge, out = parse_split(spec), 0.0, None
    u = unit(order, seed)
    for name, r in parts[:-1]:
        edge += r
        out = F.when(u <= edge, name) if out is None else out.when(u <= edge, name)
    return df.withColumn("_split", out.otherwise(parts[-1][0]))


def with_rank(df: DataFrame, order: str, name: str = "_rank") -> DataFrame:
    """0-based position in the order: ranges are sorted in parallel and offset by the sizes of those before them."""
    spark = df.sparkSession
    d = staged(spark, df.orderBy(order).withColumn("__part", F.spark_partition_id()), "sorted")
    sizes = {r["__part"]: r["n"] for r in d.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    base, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, base))
        base += sizes[p]
    if not rows:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.broadcast(spark.createDataFrame(rows, "__part int, __base long"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return d.withColumn("__local", local).join(start, "__part").withColumn(name, (F.col("__local") + F.col("__base")).cast("long")).drop("__part", "__local", "__base")


def shards(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds _shard: exactly `size` rows each in order, the last one fewer."""
    if size < 1:
        raise ConfigError("shard_size is positive")
    return with_rank(df, order).withColumn("_shard", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def skip(df: DataFrame, order: str, first: int = 0, most: int | None = None) -> DataFrame:
    d = with_rank(df, order).where(F.col("_rank") >= first)
    return (d if most is None else d.where(F.col("_rank") < first + most)).drop("_rank")
