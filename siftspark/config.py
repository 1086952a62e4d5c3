"""Options of a curation run, their checks, the three profiles, and config files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace


class ConfigError(ValueError):
    """An option that can't hold."""


@dataclass
class CurationConfig:
    # cleaning and redaction
    clean_html: bool = False
    remove_pii: bool = False
    pii_mask: bool = False
    pii_pseudonymize: bool = False
    redact_secrets: bool = False
    extra_patterns: list[tuple[str, str, str]] = field(default_factory=list)  # (pattern, token, kind)
    ner: Callable | None = None  # text -> [(start, end, kind)]
    ner_entities: tuple[str, ...] = ("person",)
    # fields
    rename: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    pii_only: list[str] = field(default_factory=list)
    no_clean: list[str] = field(default_factory=list)
    max_tokens: int | None = None
    # gates
    text_fields: list[str] | None = None
    require_fields: list[str] = field(default_factory=list)
    min_chars: int = 50
    max_chars: int = 20_000
    min_words: int = 8
    min_unique_ratio: float = 0.25
    min_ascii_ratio: float = 0.85
    reject_allcaps: bool = False
    allcaps_min_len: int = 50
    allcaps_min_alpha: int = 10
    reject_code: bool = False
    reject_profanity: bool = False
    quality_check: Callable | None = None  # Column of the record struct -> boolean Column
    lang_filter: list[str] | None = None
    detector: Callable | None = None  # Column of text -> Column of language
    # formats and chat
    format_chatml: bool = False
    format_instruct: bool = False
    validate_chat: bool = False
    chat_lenient: bool = False
    chat_max_tokens: int | None = None
    chat_roles: tuple[str, ...] = ("system", "user", "assistant")
    # decontamination
    decontam_refs: list[str] | None = None
    decontam_ngram: int = 8
    decontam_min_hits: int = 1
    # scoring and selection
    scorer: str = "heuristic"
    perplexity: Callable | None = None  # Column of text -> Column of perplexity
    quality_min_score: float | None = None
    keep_top_percent: float | None = None
    quality_score_field: str | None = None
    sample: float | None = None
    seed: int = 0
    # dedup
    deduplicate: bool = False
    fuzzy_dedup: bool = False
    fuzzy_threshold: float = 0.8
    semantic_dedup: bool = False
    semantic_threshold: float = 0.9
    embedding: str | None = None  # the column that holds vectors
    dedup_fields: list[str] | None = None
    dedup_normalize: bool = False
    dedup_state: str | None = None  # folder of the keys of earlier runs

    def validate(self) -> CurationConfig:
        def need(ok: bool, said: str) -> None:
            if not ok:
                raise ConfigError(said)

        inside = lambda v, low, high: v is None or low <= v <= high
        need(inside(self.quality_min_score, 0, 1), "quality_min_score lies in 0..1")
        need(self.keep_top_percent is None or 0 < self.keep_top_percent <= 100, "keep_top_percent lies above 0, up to 100")
        need(0 < self.fuzzy_threshold <= 1 and 0 < self.semantic_threshold <= 1, "thresholds lie above 0, up to 1")
        need(not (self.fuzzy_dedup and self.semantic_dedup), "fuzzy and semantic dedup exclude each other")
        need(not self.semantic_dedup or bool(self.embedding), "semantic dedup needs the name of a vector column")
        need(self.decontam_ngram >= 2, "decontam_ngram is 2 or more")
        need(self.decontam_min_hits >= 1, "decontam_min_hits is 1 or more")
        need(not self.lang_filter or self.detector is not None, "lang_filter needs a detector; without one every row would go")
        need(self.scorer in ("heuristic", "perplexity"), f"unknown scorer {self.scorer!r}")
        need(self.scorer != "perplexity" or self.perplexity is not None, "the perplexity scorer needs a perplexity function")
        need(self.sample is None or 0 < self.sample <= 1, "sample lies above 0, up to 1")
        need(self.max_tokens is None or self.max_tokens > 0, "max_tokens is positive")
        return self


PROFILES: dict[str, dict] = {
    "fine-tune": {"min_chars": 20, "min_words": 5, "clean_html": True, "remove_pii": True, "redact_secrets": True, "dedup_normalize": True, "deduplicate": True},
    "pretrain": {"quality_min_score": 0.3, "min_unique_ratio": 0.35, "min_chars": 200, "min_words": 50, "clean_html": True, "redact_secrets": True, "deduplicate": True},
    "rag": {"min_chars": 50, "min_words": 10, "clean_html": True, "remove_pii": True, "redact_secrets": True, "dedup_normalize": True, "deduplicate": True},
}


def load_file(path: str) -> dict:
    """A JSON or YAML mapping; keys that no option has are left out."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            got = yaml.safe_load(f)
        else:
            got = json.load(f)
    known = {x.name for x in fields(CurationConfig)}
    return {k.replace("-", "_"): v for k, v in (got or {}).items() if k.replace("-", "_") in known}


def resolve(explicit: dict | None = None, file: dict | None = None, profile: str | None = None) -> CurationConfig:
    """Explicit options win over the file's, these over the profile's, these over defaults."""
    if profile is not None and profile not in PROFILES:
        raise ConfigError(f"unknown profile {profile!r}; there are {', '.join(PROFILES)}")
    return replace(CurationConfig(), **(PROFILES.get(profile or "", {}) | (file or {}) | (explicit or {}))).validate()
