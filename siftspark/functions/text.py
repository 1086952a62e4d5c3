"""Text columns: cleaning, the bounded text that gates look at, and the gates themselves.

Java's classes differ from Unicode's letters and digits, so they are spelt out: a word is [\\p{L}\\p{N}_]+ and white
space holds the separators that Java's \\s leaves out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

W = r"[\p{L}\p{N}_]"
WORD = W + "+"
SPACES = "[\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Word boundaries next to a word character.
LEFT, RIGHT = f"(?<!{W})", f"(?!{W})"
BUDGET = 8192
#: Rows and bytes of a batch that are Python values at one time; a longer row is alone.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(v: pa.Array) -> Iterator[pa.Array]:
    """An array in consecutive slices of at most SLICE_ROWS rows and SLICE_BYTES bytes, one row at least."""
    at = 0
    while at < len(v):
        n = min(SLICE_ROWS, len(v) - at)
        while n > 1 and v.slice(at, n).nbytes > SLICE_BYTES:
            n //= 2
        yield v.slice(at, n)
        at += n


def in_slices(kind: T.DataType | str):
    """A UDF from f(array) -> array. A batch holds up to 10,000 rows or 64 MB, and its values, results and their arrays take
    a multiple of that in each worker; so a batch goes through f, and back to Spark, slice by slice."""

    def add(f: Callable[[pa.Array], pa.Array]):
        @arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for v in batches:
                for part in slices(v):
                    yield f(part)

        return run

    return add


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data):
        self.found.append(data)


def html_to_text(page: str) -> str:
    """The text chunks between tags, joined by spaces. Scripts' bodies stay, comments go, and what an unfinished tag or
    reference at the end holds back is left out."""
    if "<" not in page and "&" not in page:
        return page
    p = _Text()
    p.feed(page)
    return " ".join(p.found)


@in_slices(T.StringType())
def strip_html(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else html_to_text(x) for x in v.to_pylist()], pa.string())


_CONTROL, _BLANKS, _GAPS = re.compile(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"), re.compile(r"[ \t]+"), re.compile(r"\n{3,}")


def clean(text: str, html: bool = False) -> str:
    """NFKC, optional tag removal, control characters to spaces, single spaces, at most one blank line, trimmed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if html:
        text = html_to_text(text)
    if not text.isprintable():  # line feeds aren't printable either
        text = _CONTROL.sub(" ", text)
    if "  " in text or "\t" in text:
        text = _BLANKS.sub(" ", text)
    if "\n" in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")  # no two spaces are left here
        if "\n\n\n" in text:
            text = _GAPS.sub("\n\n", text)
    return text.strip()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def clean_text(c: Column, html: bool = False) -> Column:
    """clean() on a column. Spark has no NFKC, so texts go through Arrow in any case; the other steps go with it."""

    @in_slices(T.StringType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else clean(x, html) for x in v.to_pylist()], pa.string())

    return run(c)


def cut_tokens(text: str, n: int) -> str:
    words = text.split()
    return " ".join(words[:n]) if len(words) > n else text


def walk(value, kind: T.DataType, f: Callable[[str], str]):
    """f on every string at any depth of a Python value of this Spark type; keys of maps and other values pass."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return f(value)
    if isinstance(kind, T.ArrayType):
        return [walk(x, kind.elementType, f) for x in value]
    if isinstance(kind, T.MapType):
        return [(k, walk(v, kind.valueType, f)) for k, v in value]
    if isinstance(kind, T.StructType):
        return {x.name: walk(value[x.name], x.dataType, f) for x in kind.fields}
    return value


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.filter(F.split(c, f"{SPACES}+"), lambda x: x != "")


def truncate(c: Column, n: int) -> Column:
    w = tokens(c)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c)


def map_strings(c: Column, kind: T.DataType, f) -> Column:
    """f on every string at any depth of a column of this type; other values pass."""
    if isinstance(kind, T.StringType):
        return f(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: map_strings(x, kind.elementType, f)) if has_strings(kind) else c
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: map_strings(v, kind.valueType, f)) if has_strings(kind.valueType) else c
    if isinstance(kind, T.StructType) and has_strings(kind):
        return F.when(c.isNotNull(), F.struct(*[map_strings(c[x.name], x.dataType, f).alias(x.name) for x in kind.fields]))
    return c


def has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(has_strings(x.dataType) for x in kind.fields)
    return isinstance(kind, T.StringType)


def quality_text(schema: T.StructType, text_fields: Sequence[str] | None = None, budget: int = BUDGET) -> Column:
    """What gates look at: the strings of a record, in order, joined by spaces, within one budget of characters.

    Values that aren't strings count as empty (their separators stay); arrays join theirs first. Fields after the one
    that exhausts the budget are left out with their separators."""
    by = {x.name: x for x in schema.fields}
    names = list(text_fields) if text_fields else [x.name for x in schema.fields]

    def flat(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(c, F.lit(""))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_join(F.transform(c, lambda x: flat(x, kind.elementType)), " "), F.lit(""))
        if isinstance(kind, T.MapType):
            return F.coalesce(F.array_join(F.transform(F.map_values(c), lambda x: flat(x, kind.valueType)), " "), F.lit(""))
        if isinstance(kind, T.StructType):
            return F.coalesce(F.concat_ws(" ", *[flat(c[x.name], x.dataType) for x in kind.fields]), F.lit(""))
        return F.lit("")

    out, used = None, F.lit(0)
    for n in names:
        part = flat(F.col(f"`{n}`"), by[n].dataType) if n in by else F.lit("")
        cut = part.substr(F.lit(1), F.greatest(F.lit(budget) - used, F.lit(0)))
        out = cut if out is None else F.when(used < budget, F.concat(out, F.lit(" "), cut)).otherwise(out)
        used = used + F.length(cut)
    return F.lit("") if out is None else out


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def is_code(t: Column) -> Column:
    """More than 1 in 20 characters are code signs, or a line starts like a statement."""
    signs = F.length(F.regexp_replace(t, r"[^{}\[\]();=<>]", ""))
    w = WORD
    heads = rf"def |class {w}[:(]|function{SPACES}*{W}*{SPACES}*\(|import {w}|from {w} import |#include{SPACES}*<|public static void|(?:const|let|var) {w}{SPACES}*="
    marks = rf"(?:^|\n){SPACES}*(?:{heads})|console\.log\(|require\(['\"]|=>{SPACES}*\{{|;{SPACES}*\n"
    return (t != "") & ((share(signs, F.length(t)) > 0.05) | t.rlike(marks))


_RUDE = sorted("twat prick jackass douchebag retard nigga nigger faggot whore slut wanker dickhead cunt bastard bitch asshole bullshit shit motherfucker fucker fucking fuck".split())


def is_profane(t: Column) -> Column:
    return t.rlike(f"(?iu){LEFT}(?:{'|'.join(_RUDE)}){RIGHT}")


def gate(t: Column, cfg) -> Column:
    """True where the text passes all quality gates."""
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(t)
    ok = (t != "") & chars.between(cfg.min_chars, cfg.max_chars) & (n >= cfg.min_words)
    ok &= share(F.size(F.array_distinct(words)), n) >= cfg.min_unique_ratio
    ok &= share(F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")), chars) >= cfg.min_ascii_ratio
    if cfg.reject_allcaps:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
        ok &= ~((chars > cfg.allcaps_min_len) & (letters >= cfg.allcaps_min_alpha) & (share(upper, letters) >= 0.9))
    return ok


def is_missing(c: Column, kind: T.DataType) -> Column:
    """Null, a blank string or an empty container; 0 and False are present."""
    if isinstance(kind, T.StringType):
        return c.isNull() | (strip(c) == "")
    if isinstance(kind, T.ArrayType | T.MapType):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()
