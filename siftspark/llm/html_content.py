"""Operator 8: main text of pages by sum-product on the DOM tree.

A page is a tree of block elements and text runs (dom.parse). Each node is main content (1) or not (0). The model is a
tree-structured Markov field: a potential per parent-child pair of states and kind of child, and potentials of a node's
state with each of its features (tag, words in class, id and role, place below a landmark, length, share of links,
sentence ends, links in the subtree). Potentials are smoothed conditional frequencies learnt from labelled pages. A pass
of messages from the leaves up and one from the root down give each node's marginal; text runs with a marginal of 0.5
or more are the main text, in page order, joined by one space.

The labelled pages are written by labelled_pages(): layouts with known content, seeded, of a fixed number; the model is
learnt once per process.

Nulls and edges: null html counts as empty and gives the empty text; null ids and urls are kept; unclosed and stray tags
are tolerated; repeated rows are kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Node, attributes, parse

PAGES, SEED, SMOOTH, KEEP = 900, 3, 0.5, 0.5
#: How much a node's several features, which aren't independent, count together.
TEMPER = 0.7

LANDMARKS = frozenset("nav header footer aside form article main dialog address menu".split())
HINTS = {
    "ad": r"ads?|advert\w*|sponsor\w*|promo\w*|banner|adsense|adslot|adbox|outbrain|taboola",
    "nav": r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|skip|tabs?|toc",
    "head": r"header|masthead|topbar|branding|logo",
    "foot": r"footer|copyright|colophon|legal|bottom",
    "side": r"side\w*|aside|rail|widgets?|related|recommended|recommendations|popular|trending|more",
    "note": r"cookies?|consent|notices?|gdpr|popup|modal|overlay|alert|newsletter|subscribe|signup|paywall|banner|privacy|toast",
    "talk": r"comments?|replies|reply|respond|disqus|discussion|reactions|feedback",
    "form": r"forms?|search\w*|login|register",
    "share": r"shar\w*|social|follow|meta|byline|tags?|print",
    "body": r"content|article\w*|post|entry|story|main|body|text|prose|page",
}
_HINT = [(k, re.compile(rf"(?:^|[^a-z])(?:{v})(?:$|[^a-z])", re.I)) for k, v in HINTS.items()]
_HINTED: dict[str, tuple[str, ...]] = {}
_END = re.compile(r"[.!?…。:](?:\s|$)")


def _hints(attrs: str) -> tuple[str, ...]:
    if not attrs:
        return ()
    if attrs not in _HINTED:
        if len(_HINTED) > 5000:
            _HINTED.clear()
        a = attributes(attrs)
        said = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-testid")))
        _HINTED[attrs] = tuple(k for k, p in _HINT if p.search(said.replace("_", "-")))
    return _HINTED[attrs]


def _bin(n: int) -> int:
    return min(10, n.bit_length())


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """What each node's potentials look at."""
    n = len(nodes)
    chars, links = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            chars[i], links[i] = sum(map(len, x.pieces)), x.links
        if x.parent >= 0:
            chars[x.parent] += chars[i]
            links[x.parent] += links[i]
    mark, said = ["-"] * n, [""] * n
    out = []
    for i, x in enumerate(nodes):
        up = x.parent
        own = _hints(x.attrs)
        mark[i] = x.tag if x.tag in LANDMARKS else mark[up] if up >= 0 else "-"
        said[i] = own[0] if own else said[up] if up >= 0 else ""
        share = 4 * links[i] // max(1, chars[i])
        f = [f"t:{x.tag}", f"l:{share}"]
        if x.tag == "#text":
            body = "".join(x.pieces)
            f += [f"n:{_bin(chars[i]) // 2}", f"e:{bool(_END.search(body))}", f"p:{nodes[up].tag}"]
        else:
            f += [f"h:{h}" for h in own] or ["h:"]
        f.append(f"m:{mark[i]}")
        out.append(tuple(f))
    return out


def kind(x: Node) -> str:
    """Kinds of children with pair potentials of their own."""
    if x.tag in LANDMARKS or x.tag == "#text":
        return x.tag
    h = _hints(x.attrs)
    return f"h:{h[0]}" if h else "h" if x.tag[0] == "h" and x.tag[1:].isdigit() else x.tag if x.tag in ("p", "li", "ul", "ol", "table") else "-"


class TreeModel:
    """Log potentials of features and of parent-child pairs."""

    def __init__(self):
        self.unary: dict[str, tuple[float, float]] = {}
        self.pair: dict[str, tuple[float, float, float, float]] = {}
        self.any = (0.0, 0.0, 0.0, 0.0)

    def learn(self, pages: list[tuple[list[Node], list[int]]]) -> TreeModel:
        seen, edges, states = (Counter(), Counter()), {}, Counter()
        every = [SMOOTH] * 4
        for nodes, labels in pages:
            for i, (x, f, y) in enumerate(zip(nodes, features(nodes), labels)):
                states[y] += 1
                seen[y].update(f)
                if x.parent >= 0:
                    k = 2 * labels[x.parent] + y
                    edges.setdefault(kind(x), [SMOOTH] * 4)[k] += 1
                    every[k] += 1
        for f in seen[0].keys() | seen[1].keys():
            self.unary[f] = tuple(TEMPER * math.log((seen[y][f] + SMOOTH) / (states[y] + 2 * SMOOTH)) for y in (0, 1))

        def logs(c: list[float]) -> tuple[float, float, float, float]:
            return tuple(math.log(c[2 * p + y] / (c[2 * p] + c[2 * p + 1])) for p in (0, 1) for y in (0, 1))

        self.any = logs(every)
        # an edge kind's frequencies are divided by the child's own share of states, which the features say already
        share = [math.log((states[y] + 1) / (sum(states.values()) + 2)) for y in (0, 1)]
        fix = lambda v: tuple(v[2 * p + y] - TEMPER * share[y] for p in (0, 1) for y in (0, 1))
        self.pair = {k: fix(logs(c)) for k, c in edges.items()}
        self.any = fix(self.any)
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node: messages up (children come after parents), then down."""
        n = len(nodes)
        un = self.unary
        none = (0.0, 0.0)
        b0, b1 = [0.0] * n, [0.0] * n
        for i, f in enumerate(features(nodes)):
            for k in f:
                u = un.get(k, none)
                b0[i] += u[0]
                b1[i] += u[1]
        up0, up1, pairs = [0.0] * n, [0.0] * n, [self.any] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            p = pairs[i] = self.pair.get(kind(nodes[i]), self.any)
            a, b, c, d = p[0] + b0[i], p[1] + b1[i], p[2] + b0[i], p[3] + b1[i]
            m0 = a + log(1 + exp(min(700, b - a))) if a > b else b + log(1 + exp(a - b))
            m1 = c + log(1 + exp(min(700, d - c))) if c > d else d + log(1 + exp(c - d))
            up0[i], up1[i] = m0, m1
            b0[nodes[i].parent] += m0
            b1[nodes[i].parent] += m1
        # b: own evidence and that of all below; now add what comes from above
        out = [0.0] * n
        t0, t1 = b0[:], b1[:]
        for i in range(n):
            if i:
                q = nodes[i].parent
                g0, g1 = t0[q] - up0[i], t1[q] - up1[i]
                p = pairs[i]
                a, b, c, d = g0 + p[0], g1 + p[2], g0 + p[1], g1 + p[3]
                t0[i] += max(a, b) + log(1 + exp(-abs(a - b)))
                t1[i] += max(c, d) + log(1 + exp(-abs(c - d)))
            z = t0[i] - t1[i]
            out[i] = 1 / (1 + exp(z)) if z < 700 else 0.0
        return out


# -- labelled pages ------------------------------------------------------------------------------------------------

_MARK = "⁣"  # stands before text that isn't content; taken out before features are made


def _prose(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice("abcdefghilmnoprstuvwé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
    out, start = [], True
    for w in words:
        w = w.capitalize() if start else w
        start = r.random() < 0.12
        out.append(w + ("." if start else "," if r.random() < 0.05 else ""))
    return " ".join(out) + ("." if r.random() < 0.85 else "")


def _junk(r: random.Random, low: int, high: int) -> str:
    return _MARK + _prose(r, low, high)


def _links(r: random.Random, n: int) -> str:
    item = lambda: f'<a href="/x">{_junk(r, 1, 4)}</a>'
    if r.random() < 0.7:
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
    return r.choice([" | ", " ", "\n"]).join(item() for _ in range(n))


def _content(r: random.Random) -> str:
    parts = []
    if r.random() < 0.9:
        parts.append(f"<h1>{_prose(r, 2, 12)}</h1>")
    for _ in range(r.randint(1, 14)):
        k = r.random()
        text = _prose(r, 1, 8) if r.random() < 0.25 else _prose(r, 8, 120)
        if r.random() < 0.2:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "")
        if r.random() < 0.15:
            text += f' <a href="/y">{_prose(r, 1, 4)}</a> {_prose(r, 1, 9)}'
        if k < 0.66:
            parts.append(f"<p>{text}" + r.choice(["</p>", "</p>", "<br>", ""]))
        elif k < 0.74:
            parts.append(f"<h{r.randint(2, 4)}>{_prose(r, 1, 7)}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
        elif k < 0.82:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 2, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif k < 0.87:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif k < 0.91:
            parts.append("<table>" + "".join(f"<tr><td>{_prose(r, 1, 4)}</td><td>{_prose(r, 1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif k < 0.94:
            parts.append(f"<pre><code>{_prose(r, 3, 40)}</code></pre>")
        elif k < 0.96:
            parts.append(f"<figure><img src=x><figcaption>{_prose(r, 2, 10)}</figcaption></figure>")
        elif k < 0.98:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(_block(r, r.choice(["ad", "share", "note", "side", "form"])))
    return "".join(parts)


def _block(r: random.Random, what: str) -> str:
    """A block that isn't content."""
    pick = r.choice
    div = lambda names, body, tag="div": f'<{tag} {pick(["class", "class", "id"])}="{pick(names)}">{body}</{tag}>'
    if what == "nav":
        body = _links(r, r.randint(2, 9))
        return pick([f"<nav>{body}</nav>", div(["menu", "navbar", "main-nav", "breadcrumb", "pagination"], body), f"<nav class='menu'>{body}</nav>", div(["nav", "menu"], body, "ul")])
    if what == "header":
        body = pick([f"<a href='/'>{_junk(r, 1, 4)}</a>", f"<h1>{_junk(r, 1, 4)}</h1><p>{_junk(r, 2, 9)}</p>", f"<div class='logo'>{_junk(r, 1, 3)}</div>" + _links(r, 3), _junk(r, 2, 20)])
        return pick([f"<header>{body}</header>", div(["header", "site-header", "masthead", "topbar"], body)])
    if what == "footer":
        body = pick([f"&copy; {_junk(r, 1, 30)}", f"<p>{_junk(r, 2, 30)}</p>" + _links(r, 4), _links(r, 5), f"{_MARK}&copy; example &middot; {_junk(r, 5, 60)}"])
        body = _MARK + body
        return pick([f"<footer>{body}</footer>", f"<footer>{body}</footer>", div(["footer", "site-footer", "copyright"], body)])
    if what == "side":
        body = pick([f"<h3>{_junk(r, 1, 4)}</h3>" + _links(r, r.randint(2, 7)), f"<p>{_junk(r, 3, 60)}</p>", _junk(r, 3, 60), f"<h4>{_junk(r, 1, 3)}</h4><p>{_junk(r, 5, 40)}</p>"])
        return pick([f"<aside>{body}</aside>", f"<aside class='related'>{body}</aside>", div(["sidebar", "side-bar", "widget", "related", "right-rail", "popular"], body)])
    if what == "ad":
        body = pick([_junk(r, 2, 50), f"<p>{_junk(r, 2, 40)}</p>", f"<a href='/b'>{_junk(r, 2, 20)}</a>"])
        return pick([div(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement"], body), div(["ad", "promo"], body, "section"), div(["ad", "sponsor"], body, "aside")])
    if what == "note":
        body = pick([_junk(r, 3, 50), f"<p>{_junk(r, 3, 40)}</p><button>ok</button>"])
        return pick([div(["cookie-notice", "cookie", "notice", "consent", "gdpr-banner", "popup", "alert", "newsletter", "paywall"], body), f"<dialog>{body}</dialog>", f"<div role='alert'>{body}</div>", div(["cookie-banner", "notice"], body, "section")])
    if what == "form":
        return f"<form action='/s'>{pick(['<label>' + _junk(r, 1, 6) + '</label>', _junk(r, 1, 20), '<p>' + _junk(r, 2, 30) + '</p>'])}<input name=q><button>{_junk(r, 1, 2)}</button></form>"
    if what == "share":
        return div(["share", "social", "share-buttons", "tags", "byline"], pick([_links(r, 4), _junk(r, 2, 8)]))
    item = lambda: pick([f"<p>{_junk(r, 1, 60)}</p>", f"<div class='comment'><b>{_junk(r, 1, 2)}</b><p>{_junk(r, 2, 50)}</p></div>", f"<li>{_junk(r, 2, 50)}</li>", f"<article class='comment'><p>{_junk(r, 2, 60)}</p></article>"])
    body = pick(["", f"<h3>{_junk(r, 1, 3)}</h3>"]) + "".join(item() for _ in range(r.randint(1, 6)))
    return pick([div(["comments", "comment-list", "respond", "replies", "discussion"], body), div(["comments", "reader-comments"], body, "section"), div(["comments"], body, "ol")])


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Node], list[int]]]:
    """Trees of seeded pages and the state of each node: a text run's own, an element's as that of any run below."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        wrap = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<article class="post"><header>{}</header></article>', '<section class="entry-content">{}</section>', "<div>{}</div>"])
        body = _content(r)
        if "<header>{}" in wrap:  # an article's own header with its title
            cut = body.find("</h1>") + 5
            body = wrap.replace("{}</header>", body[:cut] + "</header>" + body[cut:]) if cut > 4 else f"<article>{body}</article>"
        else:
            body = wrap.format(body)
        before = "".join(_block(r, k) for k in ("note", "header", "nav", "ad", "form", "side") if r.random() < 0.45)
        after = "".join(_block(r, k) for k in ("share", "talk", "side", "nav", "ad", "form", "note", "footer") if r.random() < 0.4)
        if r.random() < 0.15:
            before, after = f'<div class="{r.choice(["wrap", "container", "page", "layout"])}">{before}', after + "</div>"
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}{body}{after}" + r.choice(["</body></html>", ""])
        nodes = parse(page)
        labels = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if x.tag == "#text":
                labels[i] = int(_MARK not in "".join(x.pieces))
                x.pieces = [p.replace(_MARK, "") for p in x.pieces]
            if labels[i] and x.parent >= 0:
                labels[x.parent] = 1
        out.append((nodes, labels))
    return out


_MODEL: list[TreeModel] = []


def trained() -> TreeModel:
    if not _MODEL:
        _MODEL.append(TreeModel().learn(labelled_pages()))
    return _MODEL[0]


def main_text(page: str, model: TreeModel | None = None) -> str:
    nodes = parse(page)
    if len(nodes) < 2:
        return ""
    p = (model or trained()).marginals(nodes)
    return " ".join(t for x, q in zip(nodes, p) if x.tag == "#text" and q >= KEEP and (t := x.text()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html), in place."""

    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id AS long) page_id", "cast(url AS string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
