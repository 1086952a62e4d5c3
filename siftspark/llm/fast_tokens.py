"""Exact ids of a public tokenizer for whole texts, with every distinct space-delimited piece encoded once per worker.

Both tokenizers split a text before they merge, and a single space between two characters that aren't white space is
always such a split. So a text's ids are those of its pieces in order, and the pieces' ids are kept in a bounded,
two-generation cache. Texts in which a special token's string occurs go to the library whole."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that one generation of a worker's cache holds (some 60 MB for both).
CACHE = 300_000

#: White space other than the space and the line feed; a text with any of it is split with more care.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_PAIRS = ("  ", " \n", "\n ", "\n\n")


_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def _odd(text: str) -> bool:
    """Whether white space occurs other than as single spaces and line feeds between other characters."""
    if any(p in text for p in _PAIRS) or text[0].isspace() or text[-1].isspace():
        return True
    return any(c in text for c in (_RARE if not text.isascii() else _RARE[:8]))


def _latin(word: str) -> bool:
    """Letters of Latin script only, on whose class and case all Unicode versions agree."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; callers may pass their own path wherever one is taken."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_map() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cache(dict):
    """Missing pieces come from the older generation or from make(piece)."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class FastEncoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model, self.pre, self.norm = self.t.model, self.t.pre_tokenizer, self.t.normalizer
        self.wide = self.t.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.special = [a.content.lower() for a in self.t.get_added_tokens_decoder().values()]
        self.map = _byte_map()
        self.spaced = self.norm is None  # byte-level: a piece keeps the space before it
        self.ends = {c: self.whole(c) for c in ",."}
        self.feed = self.whole("\n")
        self.cache = _Cache(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _merge(self, word: str) -> bytes:
        """ids of one pre-token that is given as characters."""
        if not word.isascii() or not self.plain(word):
            word = word.encode().decode("latin-1").translate(self.map)
        return array(self.code, [x.id for x in self.model.tokenize(word)]).tobytes()

    @staticmethod
    def plain(word: str) -> bool:
        return word.isalpha()

    def _piece(self, key: str) -> bytes:
        """ids of a piece: with the space before it, unless it starts with a line feed."""
        if key[-1:] in self.ends and _latin(stem := key[:-1]):  # its last character is a pre-token by itself
            return self.cache[stem] + self.ends[key[-1]]
        if self.spaced:
            if _latin(key):
                if key.isascii():
                    return array(self.code, [x.id for x in self.model.tokenize("\u0120" + key)]).tobytes()
                return self._merge(" " + key)
            if key[:1] == "\n" and _latin(key[1:]):
                return self.feed + self._merge(key[1:])
            return self.whole(key if key[:1] == "\n" else " " + key)
        if key[:1] == "\n" and "\n" not in key[1:]:
            return self.cache[key[1:]] if len(key) > 1 else b""
        if _latin(key) and "İ" not in key and unicodedata.is_normalized("NFC", key):
            return self._merge(key.lower())
        return self.whole(key)

    def whole(self, text: str) -> bytes:
        return self._pack(self.t.encode(text, add_special_tokens=False).ids)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian integers of self.kind."""
        if not text:
            return b""
        if "|>" in text and any(s in text.lower() for s in self.special):
            return self.whole(text)
        self.cache.trim()
        if not self.spaced:
            return b"".join(map(self.cache.__getitem__, text.replace("\n", " \n").split(" ")))
        head, *rest = _SINGLE.split(text) if _odd(text) else text.replace("\n", " \n").split(" ")
        return self.whole(head) + b"".join(map(self.cache.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.kind)


_OPEN: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _OPEN:
        _OPEN[path] = FastEncoder(path)
    return _OPEN[path]
