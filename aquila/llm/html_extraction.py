"""Main text of web pages by a tree-structured graphical model.

Every block element is a variable: content or not. Its own features (kind of tag, words of class and id, text and links)
give a unary potential, and each parent-child edge a pair potential. Messages passed from the leaves up and from the root
down give exact marginals; blocks of marginal one half or more are the text. The potentials are trained by the likelihood
of labelled pages, which html_pages.py lays out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from aquila.llm.batches import map_chunks
from aquila.llm.html_pages import labelled_pages
from aquila.llm.tables import load

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: HTML elements by kind (fixed values of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
BLOCK = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article aside header footer nav main form fieldset legend blockquote pre figure figcaption address details summary center dialog menu hgroup search".split())
#: What an opening tag closes, and the elements that it can't close through.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
KINDS = [
    {"article"}, {"main"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"div", "center"}, {"section"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"nav"}, {"header", "hgroup"},
    {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "legend", "search"}, {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"address", "details", "summary"}, {"html", "body"},
]
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags}
#: Words of class, id and role, by what they tell.
HINTS = [
    "article content post entry story body text main prose copy".split(),
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar toc skip sitemap".split(),
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner dfp adsense commercial teaser outbrain taboola affiliate".split(),
    "cookie cookies consent gdpr notice notification alert popup modal overlay privacy disclaimer paywall warning message announcement".split(),
    "sidebar side rail widget widgets related recommended recommendations popular trending more aside links tags tag".split(),
    "footer foot copyright legal colophon credits imprint bottom".split(),
    "header masthead logo brand branding tagline top topbar site banner".split(),
    "comment comments commentlist discussion disqus respond reply replies feedback reader readers reviews forum".split(),
    "share sharing social follow facebook twitter newsletter subscribe signup register login search form contact poll survey contentinfo complementary".split(),
]
HINT = {w: [i for i, ws in enumerate(HINTS) if w in ws] for ws in HINTS for w in ws}
N_TEXT = 12
WIDTH = len(KINDS) + 1 + 2 * len(HINTS) + N_TEXT + 1


@dataclass
class Page:
    """Block elements in page order, a parent before its children, and text segments in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    segments: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page(["html"], [-1], [""], [0], [])
    stack = [("html", 0, 0)]  # open elements, the block that each belongs to, and links open up to it
    places: dict[str, list[int]] = {}  # of the open elements but the root in the stack, by name
    blocks = [0]  # places of open blocks
    parts: list[str] = []
    block, in_link, at, size = 0, 0, 0, len(source)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.segments.append((block, text))
            parts.clear()

    def push(name: str, own: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, own, stack[-1][2] + (name == "a")))

    def cut_back(place: int) -> None:
        while len(stack) > place:
            places[stack.pop()[0]].pop()
        while blocks[-1] >= place:
            blocks.pop()

    while at < size:
        cut = source.find("<", at)
        if cut < 0:
            cut = size
        if cut > at:
            piece = source[at:cut]
            parts.append(piece)
            if in_link:
                page.links[block] += len(piece)
        if cut == size:
            break
        token = TOKEN.match(source, cut)
        if not token:
            parts.append("<")
            at = cut + 1
            continue
        at = token.end()
        name = token[2] or token[5]
        if not name:
            continue
        name = name.lower()
        if token[1] or token[4]:
            own = places.get(name)
            if own and (name in BLOCK or own[-1] > blocks[-1]):
                if name in BLOCK:
                    flush()
                if stack[-1][2] > stack[own[-1] - 1][2]:
                    in_link = 0
                cut_back(own[-1])
                block = stack[-1][1]
            continue
        if name in VOID:
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = close.end() if close else size
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if closes := CLOSED_BY.get(name):
                barrier = max((own[-1] for tag in BARRIER[name] if (own := places.get(tag))), default=0)
                if closed := [own[k] for tag in closes if (own := places.get(tag)) and (k := bisect_right(own, barrier)) < len(own)]:
                    cut_back(min(closed))
            else:
                while stack[blocks[-1]][0] == "p":
                    cut_back(blocks[-1])
            in_link = stack[-1][2]
            page.tag.append(name)
            page.parent.append(stack[-1][1])
            page.attrs.append(token[3] or token[6] or "")
            page.links.append(0)
            block = len(page.tag) - 1
            push(name, block)
        else:
            if name == "a":
                in_link = 1
            push(name, block)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    x = np.zeros((n, WIDTH), np.float32)
    chars, words, stops, links = np.zeros(n), np.zeros(n), np.zeros(n), np.array(page.links, float)
    last = [""] * n
    for node, text in page.segments:
        chars[node] += len(text)
        words[node] += text.count(" ") + 1
        stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        last[node] = text
    place = np.cumsum(chars) / max(1.0, chars.sum())
    whole, whole_links, whole_stops = chars.copy(), links.copy(), stops.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        whole[p] += whole[i]
        whole_links[p] += whole_links[i]
        whole_stops[p] += whole_stops[i]
    x[np.arange(n), [KIND.get(t, len(KINDS)) for t in page.tag]] = 1
    above = np.zeros((n, len(HINTS)), np.float32)
    at = len(KINDS) + 1
    for i, attrs in enumerate(page.attrs):
        if attrs:
            for m in NAMES.findall(attrs):
                for w in WORD.findall("".join(m)):
                    for k in HINT.get(w.lower(), ()):
                        x[i, at + k] = 1
        if i:
            above[i] = np.maximum(above[page.parent[i]], x[page.parent[i], at : at + len(HINTS)])
    x[:, at + len(HINTS) : at + 2 * len(HINTS)] = above
    at += 2 * len(HINTS)
    long = np.maximum(words, 1)
    x[:, at : at + N_TEXT] = np.stack([
        chars > 0, np.log1p(chars) / 5, np.log1p(words) / 3, np.minimum(links / np.maximum(chars, 1), 1), stops / long, np.array([t.endswith((".", "!", "?", ":", "\"")) for t in last]),
        np.log1p(whole) / 7, np.minimum(whole_links / np.maximum(whole, 1), 1), np.log1p(whole_stops) / 4, whole / max(1.0, chars.sum()), place, np.array(["©" in t for t in last]),
    ], 1)
    x[:, -1] = 1
    return x


def depths(parent: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parent), np.int64)
    for i in range(len(parent)):  # parents come first
        if parent[i] >= 0:
            out[i] = out[parent[i]] + 1
    return out


def marginals(unary: np.ndarray, parent: np.ndarray, pair: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a forest: each node's log-probabilities of 0 and 1 (n, 2), and each node's of its parent's and its own state
    (n, 2, 2). unary: n x 2 log-potentials; pair: n x 2 x 2 of the edge to the parent. A level at a time."""
    levels = np.split(order := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []
    up = unary.copy()
    message = np.zeros_like(unary)
    for nodes in reversed(levels[1:]):
        message[nodes] = np.logaddexp(pair[nodes, :, 0] + up[nodes, None, 0], pair[nodes, :, 1] + up[nodes, None, 1])
        np.add.at(up, parent[nodes], message[nodes])
    belief = up.copy()
    joint = np.zeros_like(pair)
    for nodes in levels[1:]:
        rest = belief[parent[nodes]] - message[nodes]
        joint[nodes] = rest[:, :, None] + pair[nodes] + up[nodes][:, None, :]
        belief[nodes] = np.logaddexp(joint[nodes, 0], joint[nodes, 1])
    belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
    joint -= np.logaddexp(np.logaddexp(joint[:, 0, 0], joint[:, 0, 1]), np.logaddexp(joint[:, 1, 0], joint[:, 1, 1]))[:, None, None]
    return belief, joint


@dataclass
class Model:
    """weights: of a node's features for content. edges: by the child's kind, states of parent and child."""

    weights: np.ndarray
    edges: np.ndarray

    def potentials(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = x @ self.weights
        kind = x[:, : len(KINDS) + 1].argmax(1)
        return np.stack([np.zeros_like(score), score], 1), self.edges[kind]

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page the marginal of content of each node."""
        if not pages:
            return []
        sizes = [len(p.tag) for p in pages]
        first = np.cumsum(sizes) - sizes
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first)])
        unary, pair = self.potentials(np.concatenate([features(p) for p in pages]).astype(np.float64))
        belief, _ = marginals(unary, parent, pair, depths(parent))
        return np.split(np.exp(belief[:, 1]), np.cumsum(sizes)[:-1])


def train(pages: list[str], rounds: int = 150, rate: float = 0.08, decay: float = 2e-4) -> Model:
    """Adam on the likelihood of the pages' labels (attribute data-y, taken over from the parent where it is missing)."""
    parsed = [parse(p) for p in pages]
    xs, ys, parents, base = [], [], [], 0
    for p in parsed:
        y = np.zeros(len(p.tag), np.int64)
        for i in range(1, len(p.tag)):
            m = re.search(r'data-y="([01])"', p.attrs[i])
            y[i] = int(m[1]) if m else y[p.parent[i]]
        xs.append(features(p))
        ys.append(y)
        parents.append(np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + base))
        base += len(y)
    x, y, parent = np.concatenate(xs).astype(np.float64), np.concatenate(ys), np.concatenate(parents)
    kind, depth = x[:, : len(KINDS) + 1].argmax(1), depths(parent)
    child = np.flatnonzero(parent >= 0)
    model = Model(np.zeros(WIDTH), np.zeros((len(KINDS) + 1, 2, 2)))
    seen = np.zeros_like(model.edges)
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), 1)
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (model.weights, model.edges)]
    for t in range(1, rounds + 1):
        unary, pair = model.potentials(x)
        belief, joint = marginals(unary, parent, pair, depth)
        expected = np.zeros_like(model.edges)
        np.add.at(expected, kind[child], np.exp(joint[child]))
        grads = [x.T @ (y - np.exp(belief[:, 1])) / len(y) - decay * model.weights, (seen - expected) / len(y) - decay * model.edges]
        for a, g, (m, v) in zip((model.weights, model.edges), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages(300))


def extract(sources: list[str | None], model: Model) -> list[str]:
    pages = [parse(s or "") for s in sources]
    out = []
    for page, content in zip(pages, model.content(pages)):
        out.append("\n".join(text for node, text in page.segments if content[node] >= 0.5))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (the main text, a block a line) and n_chars.

    Null and empty pages, and pages without a block of content, have an empty text. Broken markup is read as browsers do
    for the common cases: unclosed elements, quotes and comments end with the page. Null ids and urls stay null, repeated
    rows each get a row, an empty table gives an empty table, other columns are ignored.
    """
    model = model or default_model()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column(2).to_pylist(), model)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return map_chunks(rows, "html", f"page_id {kind}, url string, text string, n_chars bigint", lambda: step)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))
