"""A forgiving HTML parser that yields a small tree of elements and runs of text."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[\s​﻿]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Elements whose content is never page text.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button datalist map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img input".split())
#: A start tag of the key ends an open element among these.
_P_END = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th")}
_BARS = frozenset("ul ol dl table div section article body html form select aside nav main header footer".split())


class Node:
    """An element, or (tag '#text') a run of text in a block: its text pieces, and how many characters of it are links."""

    __slots__ = ("tag", "attrs", "parent", "kids", "pieces", "links", "hidden")

    def __init__(self, tag: str, attrs: str, parent: int, hidden: bool):
        self.tag, self.attrs, self.parent, self.hidden = tag, attrs, parent, hidden
        self.kids: list[int] = []
        self.pieces: list[str] = []
        self.links = 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.pieces)).strip()


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _is_hidden(attrs: str) -> bool:
    if "hidden" not in attrs and "none" not in attrs:
        return False
    a = attributes(attrs)
    return "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()


def parse(page: str) -> list[Node]:
    """Block elements and text runs, parents first. Inline elements join the run around them; block tags and <br> end it.

    Raw text ends at its end tag alone, comments and declarations vanish, unclosed elements close with their parents."""
    nodes = [Node("#root", "", -1, False)]
    stack = [0]  # open block elements
    inline: list[str] = []  # open inline and hidden-inline elements of the current block
    run = -1

    def add(data: str) -> None:
        nonlocal run
        if not data or nodes[stack[-1]].hidden:
            return
        if run < 0:
            if not data.strip():
                return
            run = len(nodes)
            nodes.append(Node("#text", "", stack[-1], False))
            nodes[stack[-1]].kids.append(run)
        if "&" in data:
            data = html.unescape(data)
        nodes[run].pieces.append(data)
        if "a" in inline:
            nodes[run].links += len(data)

    def close_to(k: int) -> None:
        nonlocal run
        del stack[k:]
        inline.clear()
        run = -1

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:  # an end tag
            if name in INLINE:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name) :]
            elif name == "br":
                add(" ")
            else:
                for k in range(len(stack) - 1, 0, -1):
                    tag = nodes[stack[k]].tag
                    if tag == name:
                        close_to(k)
                        break
                    if name == "p" and tag in _BARS or name == "li" and tag in ("ul", "ol"):
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name not in VOID and not attrs.endswith("/") and name not in ("a",):
                inline.append(name)
            elif name == "a":
                if "a" in inline:
                    del inline[inline.index("a") :]
                inline.append(name)
            continue
        if name in VOID:
            run = -1
            continue
        if name in _P_END:
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag == "p":
                    close_to(k)
                    break
                if tag in _BARS:
                    break
        if name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag in _SIBLINGS[name]:
                    close_to(k)
                    if name not in ("tr", "tbody", "thead", "tfoot"):
                        break
                elif tag in _BARS:
                    break
        if name in ("body", "html") and any(nodes[s].tag == name for s in stack):
            continue
        if name == "body":
            close_to(next((k for k, s in enumerate(stack) if nodes[s].tag == "head"), len(stack)))
        up = stack[-1]
        hidden = nodes[up].hidden or name in HIDDEN or _is_hidden(attrs)
        run = -1
        inline.clear()
        nodes[up].kids.append(len(nodes))
        nodes.append(Node(name, attrs, up, hidden))
        if not (attrs.endswith("/") and name in ("svg", "math")):
            stack.append(len(nodes) - 1)
    return nodes
