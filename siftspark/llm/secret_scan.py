"""Operator 5: secrets by fixed patterns and by novelty under dictionary-primed zstandard.

Base patterns (kinds assign, access, hex) always count. The method adds spans of kind `novel`. A candidate is a run of 16 or
more key-like characters (10 right after a sensitive name and a sign of assignment) that looks drawn, not written: letters
with two groups of digits or with jumps of case (a small letter between capitals), and frequent changes between small
letters, capitals and digits; digits alone (card or phone numbers) are none. A sensitive word (key, secret, token, password, ...) must stand in its line or the
one before, NEAR characters away at most. The candidate is appended to the AROUND characters on each side of it and both
are compressed with a dictionary of code's identifiers; the extra bytes that it costs are its novelty. A name that code or
the dictionary explains costs little, a random string its full entropy; NOVEL bits a character or more are reported.

Spans are code-point offsets, end exclusive. Nulls and edges: a null text counts as empty and has no spans; null doc_ids
and repeated rows are kept; a text of any length is scanned whole; an empty table gives no rows; other columns are
ignored by scan() and kept by redact()."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .identifiers import IDENTIFIERS

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run, as the shorter ones would be dropped
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
#: Sensitive words as words, or as parts of joined and camel-case names.
SENSITIVE = re.compile(r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:(?:api|access|private|secret)?key|secret|token|password|passwd|passphrase|pwd|auth|authorization|bearer|credential)s?(?![a-z])")
#: A sensitive word whose value starts here.
VALUE = re.compile(r"(?i:key|secret|token|password|passwd|passphrase|pwd|auth|authorization|credential)s?[\"']?\x20*[:=]\x20*[\"']?$|(?i:bearer)\x20+$")
LONG = 16
#: Characters up to a sensitive word, and around a candidate that it is compressed with; bits a character from which it is novel.
NEAR, AROUND, NOVEL = 160, 2000, 3.4


_LETTER, _DIGITS, _JUMP = re.compile("[A-Za-z]"), re.compile("[0-9]+"), re.compile(r"(?<=[A-Z])[a-z](?=[A-Z])")


def drawn(run: str) -> bool:
    """Whether a run of characters looks like a drawn key: classes are mixed and change often, unlike in joined words."""
    if run.isdigit() or not _LETTER.search(run):
        return False
    groups = len(_DIGITS.findall(run))
    if groups < 2 and len(_JUMP.findall(run)) + groups < 2:
        return False
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "" for c in run]
    return 4 * sum(x != y for x, y in zip(kinds, kinds[1:]) if x and y) >= len(run)


def _coder():
    import zstandard

    d = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False)


_CODER = []


def novelty(candidate: str, before: str, after: str) -> float:
    """Bits a character that the candidate adds to its compressed surroundings."""
    if not _CODER:
        _CODER.append(_coder())
    around = f"{before}\n{after}\n".encode()
    extra = len(_CODER[0].compress(around + candidate.encode())) - len(_CODER[0].compress(around))
    return 8 * extra / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower() if not text.isascii() else text.casefold()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive(text: str, start: int, end: int) -> bool:
    """Whether a sensitive word stands near a candidate: in its line or the one before."""
    left = text.rfind("\n", 0, max(0, text.rfind("\n", 0, start))) + 1
    right = text.find("\n", end)
    right = len(text) if right < 0 else right
    # words that the window would cut aren't looked at
    return bool(SENSITIVE.search(text, max(left, start - NEAR), min(right, end + NEAR)))


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the method that no base span holds."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if run[1:].islower() and run.isalpha():  # a word
            continue
        s, e = m.span()
        if not drawn(run) or any(a <= s and e <= b for a, _, b in base):
            continue
        if e - s < LONG and not VALUE.search(text[max(0, s - 40) : s]) or not sensitive(text, s, e):
            continue
        if novelty(run, text[max(0, s - AROUND) : s], text[e : e + AROUND]) >= NOVEL:
            found.append((s, 3, e))
    return found


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for docs (doc_id, text), in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = ([], [], []), [], []
            for text in texts_of(batch):
                text = text.as_py()
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(base + novel_spans(text, base)))
            cols = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def cleaned(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones as one) replaced by the mark."""
    base = base_spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + novel_spans(text, base)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets in `text` replaced; a null text stays null; other columns stay."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if t is None else cleaned(t, mark) for t in batch.to_pylist()], pa.string())

    from pyspark.sql.functions import arrow_udf

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("text", arrow_udf(run, "string")("text"))
