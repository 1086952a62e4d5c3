"""Run statistics, as aggregates over the annotated rows (_reason null: kept; _qtext, _score, _lang)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: As in plans.curate, which builds on this module.
SYSTEM = ("_reason", "_qtext", "_score", "_lang", "_pii", "_ord", "_malformed")
REASONS = ("malformed", "require_fields", "code", "profanity", "quality", "language", "chat", "contaminated", "low_score", "sampled_out", "duplicate")
CHARS = (0, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 20_000)
WORDS = (0, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def funnel(rows: DataFrame) -> DataFrame:
    """One row: total, kept, kept_pct and a count per reason."""
    head = F.coalesce(F.substring_index("_reason", ":", 1), F.lit("kept"))
    kept = F.count_if(F.col("_reason").isNull())
    pct = F.when(F.count("*") > 0, F.bround(kept * 100.0 / F.count("*"), 4)).otherwise(F.lit(0.0))
    return rows.agg(F.count("*").alias("total"), kept.alias("kept"), pct.alias("kept_pct"), *[F.count_if(head == r).alias(r) for r in REASONS])


def lower_edge(c: Column, edges: tuple[int, ...]) -> Column:
    out = F.lit(edges[0])
    for e in edges[1:]:
        out = F.when(c >= e, e).otherwise(out)
    return out


def histogram(rows: DataFrame, what: str = "chars") -> DataFrame:
    """bucket, n of the kept rows' texts by characters or words."""
    c = F.length("_qtext") if what == "chars" else F.size(tokens(F.col("_qtext")))
    edges = CHARS if what == "chars" else WORDS
    return rows.where("_reason IS NULL").groupBy(lower_edge(c, edges).alias("bucket")).agg(F.count("*").alias("n"))


def score_histogram(rows: DataFrame) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.col("_score") * 10)).cast("int")
    return rows.where("_reason IS NULL AND _score IS NOT NULL").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.avg("_score"), 4).alias("mean_score"))


def languages(rows: DataFrame) -> DataFrame:
    return rows.where("_reason IS NULL AND _lang IS NOT NULL").groupBy(F.col("_lang").alias("lang")).agg(F.count("*").alias("n"))


def chat_reasons(rows: DataFrame) -> DataFrame:
    d = rows.where(F.col("_reason").startswith("chat:"))
    return d.groupBy(F.substring_index("_reason", ":", -1).alias("detail")).agg(F.count("*").alias("n"))


def pii_totals(rows: DataFrame) -> DataFrame:
    """kind, n over all rows with the counters struct _pii, later dropped ones included."""
    kinds = rows.schema["_pii"].dataType.names
    one = rows.agg(*[F.coalesce(F.sum(f"_pii.{k}"), F.lit(0)).alias(k) for k in kinds])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k in kinds])).alias("x")).select("x.*").where("n > 0")


def audit_samples(rows: DataFrame, order: str, most: int = 5, chars: int = 400) -> DataFrame:
    """The first rows of each reason, as JSON cut to so many characters; duplicates and sampled-out rows give none."""
    said = [f"`{c}`" for c in rows.columns if c not in SYSTEM]
    d = rows.where("_reason IS NOT NULL AND _reason NOT IN ('duplicate', 'sampled_out')")
    w = Window.partitionBy("_reason").orderBy(order)
    d = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return d.select(F.col("_reason").alias("reason"), F.col("_n").alias("n"), F.substring(F.to_json(F.struct(*said)), 1, chars).alias("sample"))


def as_dict(rows: DataFrame) -> dict:
    """All of it, for the summary file: one row and a few short tables reach the driver."""
    out = funnel(rows).first().asDict()
    pairs = lambda df, k: {str(r[k]): r["n"] for r in df.orderBy(F.desc("n"), k).collect()}
    out |= {"char_hist": pairs(histogram(rows), "bucket"), "word_hist": pairs(histogram(rows, "words"), "bucket"), "chat_reasons": pairs(chat_reasons(rows), "detail")}
    if "_lang" in rows.columns:
        out["languages"] = pairs(languages(rows), "lang")
    if "_score" in rows.columns:
        out["score_hist"] = pairs(score_histogram(rows), "bucket")
    if "_pii" in rows.columns:
        out["pii"] = pairs(pii_totals(rows), "kind")
    return out
