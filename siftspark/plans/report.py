"""The audit report of a run: one HTML page from small aggregates."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats

_SECTIONS = {"pii": "Redacted, by kind", "chat_reasons": "Invalid conversations, by reason", "languages": "Languages", "score_hist": "Scores", "char_hist": "Characters", "word_hist": "Words"}


def _table(title: str, rows: list[tuple]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table>{body}</table>" if rows else ""


def redacted_pairs(rows: DataFrame, before: DataFrame, order: str, most: int = 5, chars: int = 400) -> list[tuple[str, str]]:
    """The first different (before, after) pairs of records in which something was redacted, as JSON cut to so many characters."""
    if "_pii" not in rows.columns:
        return []
    said = lambda d: F.substring(F.to_json(F.struct(*[f"`{c}`" for c in d.columns if c not in stats.SYSTEM])), 1, chars)
    total = sum((F.col(f"_pii.{k}") for k in rows.schema["_pii"].dataType.names), F.lit(0))
    after = rows.where(total > 0).select(F.col(order).alias("__o"), said(rows).alias("__after"))
    both = after.join(before.select(F.col(order).alias("__o"), said(before).alias("__before")), "__o")
    once = both.groupBy("__before", "__after").agg(F.min("__o").alias("__o")).orderBy("__o").limit(most)
    return [(r["__before"], r["__after"]) for r in once.collect()]


def html_report(rows: DataFrame, order: str, title: str = "Curation run", before: DataFrame | None = None) -> str:
    """Funnel, a section for each kind of counter, the first dropped records of each reason and, with the input at hand, what
    was redacted, before and after; all escaped."""
    s = stats.as_dict(rows)
    parts = [_table("Funnel", [(k, v) for k, v in s.items() if not isinstance(v, dict)])]
    parts += [_table(name, list(s[k].items())) for k, name in _SECTIONS.items() if s.get(k)]
    if before is not None and order in before.columns:
        parts.append(_table("Redacted records, before and after", redacted_pairs(rows, before, order)))
    samples = [(r["reason"], r["sample"]) for r in stats.audit_samples(rows, order).orderBy("reason", "n").collect()]  # five a reason
    parts.append(_table("Dropped records", samples))
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>" + "".join(parts)
