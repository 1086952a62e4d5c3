"""The record steps on a stream of records, with exact dedup in state; set-level ranks and pseudonyms need a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ConfigError, CurationConfig
from ..functions import text
from ..operators import dedup
from ..plans import curate


def curate_stream(df: DataFrame, cfg: CurationConfig, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Kept records of a stream: clean, redact, gate, and drop repeats. With a watermark (column, delay) the keys of exact
    dedup are forgotten after the delay."""
    if cfg.keep_top_percent or cfg.fuzzy_dedup or cfg.semantic_dedup or cfg.pii_pseudonymize:
        raise ConfigError("ranks, near dedup and pseudonyms need the whole set")
    d = curate.sanitize(curate.project(df, cfg), cfg)[0].drop("_pii")
    fields = curate.fields_of(d)
    d = d.withColumn("_qtext", text.quality_text(fields, cfg.text_fields))
    ok = text.gate(F.col("_qtext"), cfg)
    if cfg.reject_code:
        ok &= ~text.is_code(F.col("_qtext"))
    if cfg.reject_profanity:
        ok &= ~text.is_profane(F.col("_qtext"))
    d = d.where(ok)
    if cfg.deduplicate:
        d = d.withColumn("_key", dedup.record_hash(d, cfg.dedup_fields, cfg.dedup_normalize, curate.SYSTEM))
        d = d.withWatermark(*watermark).dropDuplicatesWithinWatermark(["_key"]) if watermark else d.dropDuplicates(["_key"])
    return d.select(*[f"`{f.name}`" for f in fields])
