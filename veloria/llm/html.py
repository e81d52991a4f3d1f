"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of blocks (runs of text between block-level tags). Each block is described by its own and its
neighbours' word counts and link densities and by where it stands. The tree is grown from the small labelled table below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import small_batches

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_article", "in_region", "named_aside", "heading", "paragraph", "article_share")

#: Labelled blocks: the first ten features in order, then 1 for main text. Hand-made.
_BLOCKS_BY_HAND = [
    # paragraphs of articles, long and short, beside other paragraphs and at the article's ends
    (80, 0.0, 60, 0.0, 75, 0.0, 1, 0, 0, 0, 1), (45, 0.05, 9, 0.0, 30, 0.1, 1, 0, 0, 0, 1), (12, 0.0, 80, 0.0, 66, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 50, 0.0, 70, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 12, 0.0, 8, 1.0, 1, 0, 0, 0, 1), (33, 0.3, 8, 1.0, 4, 0.0, 1, 0, 0, 0, 1),
    (5, 0.0, 7, 0.0, 9, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 10, 0.0, 0, 0.0, 1, 0, 0, 0, 1), (150, 0.1, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (20, 0.45, 40, 0.0, 35, 0.0, 1, 0, 0, 0, 1), (6, 0.5, 30, 0.0, 45, 0.0, 1, 0, 0, 0, 1), (8, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 9, 0.0, 1, 0, 0, 0, 1), (4, 0.0, 4, 0.0, 7, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 2, 0.0, 20, 0.0, 1, 0, 0, 0, 1), (7, 0.0, 3, 0.0, 5, 1.0, 1, 0, 0, 0, 1), (3, 0.5, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    # headings inside articles
    (1, 0.0, 9, 0.0, 1, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 3, 1.0, 2, 0.0, 1, 0, 0, 1, 1), (5, 0.0, 25, 0.0, 5, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 4, 0.0, 1, 0, 0, 1, 1),
    (10, 0.0, 7, 0.0, 50, 0.0, 1, 0, 0, 1, 1), (4, 0.0, 60, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (11, 0.0, 0, 0.0, 90, 0.0, 1, 0, 0, 1, 1), (9, 1.0, 6, 1.0, 44, 0.0, 1, 0, 0, 1, 1),
    (8, 0.0, 5, 1.0, 60, 0.0, 1, 1, 0, 1, 0), (7, 0.0, 5, 0.0, 9, 0.0, 1, 0, 1, 1, 0), (3, 0.0, 40, 0.0, 20, 1.0, 1, 0, 1, 1, 0),
    # link lists inside articles, as sources and further reading
    (3, 1.0, 4, 1.0, 3, 1.0, 1, 0, 0, 0, 1), (6, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0, 0, 1), (5, 1.0, 5, 1.0, 30, 0.0, 1, 0, 0, 0, 1), (2, 1.0, 3, 1.0, 0, 0.0, 1, 0, 0, 0, 1),
    # what articles hold beside their text: adverts, notices, comments, bylines in headers
    (12, 0.0, 40, 0.0, 55, 0.0, 1, 0, 1, 0, 0), (60, 0.0, 50, 0.0, 30, 0.0, 1, 0, 1, 0, 0), (4, 0.0, 10, 0.0, 30, 0.0, 1, 1, 0, 0, 0), (35, 0.1, 70, 0.0, 0, 0.0, 1, 1, 0, 0, 0), (90, 0.0, 70, 0.0, 80, 0.0, 1, 0, 1, 0, 0),
    # menus, headers, footers, sidebars, forms outside articles
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 0, 0), (9, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (40, 0.0, 12, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (7, 0.0, 3, 1.0, 30, 0.0, 0, 1, 0, 1, 0),
    (25, 0.2, 9, 1.0, 60, 0.0, 0, 1, 0, 0, 0), (90, 0.0, 20, 0.0, 33, 0.0, 0, 1, 0, 0, 0), (5, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1, 0, 0),
    # adverts, notices, comments outside articles
    (7, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 0, 0), (30, 0.0, 2, 1.0, 12, 0.0, 0, 0, 1, 0, 0), (85, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1, 0, 0), (4, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1, 1, 0), (110, 0.05, 90, 0.0, 100, 0.0, 0, 0, 1, 0, 0),
    # pages without article tags: text by its length, density and neighbours
    (60, 0.0, 10, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (35, 0.1, 50, 0.0, 5, 1.0, 0, 0, 0, 0, 1), (22, 0.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (110, 0.2, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 20, 0.0, 19, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (26, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 55, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 50, 0.0, 48, 0.0, 0, 0, 0, 1, 1), (10, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0, 1, 1),
    (3, 1.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (30, 0.9, 6, 1.0, 28, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 0),
    (9, 0.8, 30, 0.0, 10, 0.9, 0, 0, 0, 0, 0), (4, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1, 0), (6, 0.0, 50, 0.0, 5, 1.0, 0, 0, 0, 1, 0),
]


def _is_text(words: int, links: float, before: int, links_before: float, after: int, links_after: float, article: int, region: int, named: int, paragraph: int, share: float) -> bool:
    """How the blocks below are labelled: main text in articles but for what is set apart by its tag or name; on pages whose words
    are mostly in articles nothing else; on others what is long, or a paragraph that does not stand between link lists, or stands by a long
    block without links."""
    if region or named:
        return False
    if article or share > 0.3:
        return bool(article)
    by_text = before >= 60 and links_before < 0.5 or after >= 60 and links_after < 0.5
    return links < 0.5 and (words >= 15 or paragraph and not (links_before >= 0.5 and links_after >= 0.5) or words >= 4 and by_text)


def labelled_blocks() -> list[tuple]:
    """The training table: the blocks labelled by hand, as paragraphs and not, and a grid of blocks beside blocks of other lengths and links."""
    out = [(*b[:10], paragraph, 0.9 if b[6] else 0.0, b[10]) for b in _BLOCKS_BY_HAND for paragraph in (0, 1) if b[6] or b[7] or b[8] or not paragraph]
    places = [(1, r, n, 0.9) for r, n in ((0, 0), (1, 0), (0, 1))] + [(0, r, n, share) for r, n in ((0, 0), (1, 0), (0, 1)) for share in (0.0, 0.9)]
    for words, links, before, after, links_before, links_after, heading, paragraph in product((1, 4, 30, 95), (0.0, 1.0), (0, 12, 70), (0, 12, 70), (0.0, 1.0), (0.0, 1.0), (0, 1), (0, 1)):
        if not (heading and paragraph or links_before > before or links_after > after):
            for article, region, named, share in places:
                label = _is_text(words, links, before, links_before, after, links_after, article, region, named, paragraph, share)
                out.append((words, links, before, links_before, after, links_after, article, region, named, heading, paragraph, share, int(label)))
    return out


#: Elements whose content is no page text at all.
DROPPED = "script style noscript template svg iframe object canvas textarea select title head button audio video map datalist".split()
#: Those of them whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title".split())
#: What a head may hold; anything else ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noscript template".split()) | RAW
#: Elements that are boilerplate by their tag or role.
REGIONS = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class and id values that name boilerplate.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay
    comment comments commentlist disqus respond reply replies sidebar side menu navbar nav navigation breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe
    subscription signup login footer header masthead widget pagination pager toolbar tags hidden paywall disclaimer copyright""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup
    option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Words beside those in class and id values that name boilerplate; any other word makes it the name of something else.
FILLERS = frozenset(
    """a area bar block body bottom box btn button buttons center col column container content first footer form global group header holder icon icons id inline inner item items js last left link links list main module
    new outer page panel post primary right row secondary section single site slot small sticky tab tabs text thread title top unit wrap wrapper wrapping""".split()
)
PARAGRAPHS = frozenset("p pre blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open a place of their own; others have no bearing on where a block stands.
PLACES = frozenset("div section article main nav header footer aside form menu dialog fieldset ul ol li dl table td th span figure blockquote body html details center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _describe(attrs: str) -> tuple[bool, bool]:
    """(is a boilerplate region by role or hidden, has a class or id that names boilerplate)."""
    region = named = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            region |= value.strip().lower() in ROLES
        elif key == "hidden":
            region = True
        elif key == "aria-hidden":
            region |= value.lower() == "true"
        elif key == "style":
            region |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        else:
            for name in value.split():
                parts = [p.lower() for p in _PART.findall(name)]
                words = {p for p in parts if not p.isdigit()}
                named |= bool(NAMES & words) and words <= NAMES | FILLERS
    return region, named


@dataclass
class _Block:
    text: str
    words: int
    link_density: float
    in_article: bool
    in_region: bool
    named_aside: bool
    heading: bool
    paragraph: bool


@dataclass
class _Page:
    """The walk over one page's tags."""

    blocks: list[_Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    stack: list[tuple[str, bool, bool, bool]] = field(default_factory=list)
    in_link: bool = False
    heading: bool = False
    paragraph: bool = False
    #: Region and name of the open block itself, where it is no place.
    own: tuple[bool, bool] = (False, False)

    def flush(self) -> None:
        words = html.unescape("".join(self.parts)).split()
        if words:
            links = len(html.unescape(" ".join(self.linked)).split())
            _, article, region, named = self.stack[-1] if self.stack else ("", False, False, False)
            self.blocks.append(_Block(" ".join(words), len(words), min(1.0, links / len(words)), article, region or self.own[0], named or self.own[1], self.heading, self.paragraph))
        self.parts, self.linked = [], []

    def open(self, name: str, attrs: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.in_link = False
            self.paragraph = name in PARAGRAPHS
            self.own = _describe(attrs) if attrs and name not in PLACES else (False, False)
        if name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.in_link = True
        elif name in HEADINGS:
            self.heading = True
        elif name in PLACES and name not in VOID:
            region, named = _describe(attrs) if attrs else (False, False)
            if named and name in ("span", "body", "html", "article", "main"):
                named = False
            if name == "span" and not region:
                return
            if name == "li" and self.stack and self.stack[-1][0] == "li":  # its end tag was left out
                self.stack.pop()
            _, article, in_region, in_named = self.stack[-1] if self.stack else ("", False, False, False)
            if name in ("article", "main"):
                self.stack.append((name, True, in_region, in_named))
            else:
                self.stack.append((name, article, in_region or region or name in REGIONS, in_named or named))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.in_link = self.paragraph = False
            self.own = (False, False)
        if name == "a":
            self.in_link = False
        elif name in HEADINGS:
            self.heading = False
        elif name in PLACES:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    del self.stack[i:]
                    break


def _tag(m: re.Match) -> tuple[str, bool, str]:
    """(name, is an end tag, attributes) of a token; an empty name if it is no tag."""
    name = m["name"] or m["name2"]
    return (name.lower(), bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or "") if name else ("", False, "")


class _Ends:
    """Where dropped elements end, found in one pass forwards and one backwards over a page's tags.

    An element ends with its end tag. One without, by the end of what it stands in or the start of the page's text, holds nothing
    beyond the next block-level tag; a button or a selection ends where the next one opens. A head also ends where something stands
    that no head holds.
    """

    def __init__(self, tokens: list[re.Match]):
        self.tokens, self.tags = tokens, [_tag(m) for m in tokens]
        n = len(tokens)
        opens: dict[str, list[int]] = {}
        match = [-1] * n  # of an end tag its start tag, and the other way round
        for i, (name, closes, attrs) in enumerate(self.tags):
            if name and (name in DROPPED or name in PLACES):
                if not closes:
                    if not attrs.rstrip().endswith("/") or name in PLACES:
                        opens.setdefault(name, []).append(i)
                elif opens.get(name):
                    match[i] = opens[name].pop()
                    match[match[i]] = i
        self.end = [n] * n
        block, main, again = n, n, {}
        outer: list[int] = []  # end tags ahead of places that opened further and further back
        for i in range(n - 1, -1, -1):
            name, closes, _ = self.tags[i]
            if not name:
                continue
            if name in DROPPED and not closes:
                while outer and match[outer[-1]] >= i:
                    outer.pop()
                stop = min(main, outer[-1] if outer else n, again.get(name, n) if name in ("button", "select") else n)
                self.end[i] = match[i] + 1 if i < match[i] < stop else min(block, stop)
                again[name] = i
            if name in BLOCKS and name not in ("option", "optgroup"):
                block = i
            if name in ("article", "main", "body") and not closes:
                main = i
            if name in PLACES and closes:
                while outer and match[outer[-1]] >= match[i]:
                    outer.pop()
                outer.append(i)

    def after(self, at: int) -> int:
        """The place behind the dropped element that opens at ``at``."""
        name, _, attrs = self.tags[at]
        if attrs.rstrip().endswith("/"):
            return at + 1
        if name != "head":
            return self.end[at]
        i = at + 1
        while i < len(self.tokens):
            inner, closes, _ = self.tags[i]
            if closes and inner == "head":
                return i + 1
            if inner and (closes and inner in ("body", "html") or not closes and inner not in HEAD_CONTENT) or self.tokens[i].lastgroup == "text" and self.tokens[i]["text"].strip():
                return i
            i = self.after(i) if inner in DROPPED and inner not in RAW and not closes else i + 1
        return i


def text_blocks(page: str) -> list[_Block]:
    """The page's text blocks in order."""
    walk = _Page()
    tokens = list(_TOKEN.finditer(page))
    ends = _Ends(tokens)
    at = 0
    while at < len(tokens):
        m = tokens[at]
        at += 1
        if m.lastgroup == "text":
            walk.parts.append(m["text"])
            if walk.in_link:
                walk.linked.append(m["text"])
            continue
        name, closes, attrs = ends.tags[at - 1]
        if name and closes:
            walk.close(name)
        elif name in DROPPED:
            if name not in RAW:
                at = ends.after(at - 1)
        elif name:
            walk.open(name, attrs)
    walk.flush()
    return walk.blocks


def block_features(blocks: list[_Block]) -> np.ndarray:
    """One row per block in the order of FEATURES; beyond the page's ends there are no words and no links."""
    own = np.array([(b.words, b.link_density, b.in_article, b.in_region, b.named_aside, b.heading, b.paragraph) for b in blocks], np.float64).reshape(-1, 7)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1, :2]])[: len(own)], np.vstack([own[1:, :2], edge])[: len(own)]
    free = own[:, 0] * (1 - np.maximum(own[:, 3], own[:, 4]))
    share = np.full((len(own), 1), (free * own[:, 2]).sum() / max(1.0, free.sum()))
    return np.hstack([own[:, :2], before, after, own[:, 2:], share])


class DecisionTree:
    """A binary classification tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, int]] = []
        self.least = least
        self._grow(x, y)

    def _grow(self, x: np.ndarray, y: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(y.mean() >= 0.5)))
        best = (0.0, -1, 0.0)
        n, ones = len(y), y.sum()
        gini = lambda k, m: 2 * k * (m - k) / m
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(y[order])
            i = np.flatnonzero(v[1:] != v[:-1]) + 1
            i = i[(i >= self.least) & (i <= n - self.least)]
            if len(i):
                gain = gini(ones, n) - gini(left[i - 1], i) - gini(ones - left[i - 1], n - i)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, (v[i[k]] + v[i[k] - 1]) / 2)
        if best[1] >= 0:
            _, f, cut = best
            low = x[:, f] <= cut
            a, b = self._grow(x[low], y[low]), self._grow(x[~low], y[~low])
            self.nodes[at] = (f, cut, a, b, self.nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, low, high, label = (np.array(c) for c in zip(*self.nodes, strict=True))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return label[at].astype(bool)
            f = np.maximum(feature[at], 0)
            at = np.where(inner, np.where(x[np.arange(len(x)), f] <= cut[at], low[at], high[at]), at)


def train_tree(labelled: list[tuple] | None = None) -> DecisionTree:
    table = np.array(labelled or labelled_blocks(), np.float64)
    return DecisionTree(table[:, :-1], table[:, -1])


def main_texts(pages: list[str], tree: DecisionTree) -> list[str]:
    """Each page's main text; the blocks of all pages are classified together."""
    each = [text_blocks(p) for p in pages]
    found = [block_features(b) for b in each if b]
    keep = iter(tree.predict(np.vstack(found)).tolist() if found else [])
    return [" ".join(b.text for b in blocks if next(keep)) for blocks in each]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text; null ids and urls stay null; repeated rows repeat; unclosed tags and cut-off
    pages are read as far as they go. Other columns are ignored; an empty table gives no rows.
    """

    tree = train_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            texts = main_texts([h or "" for h in batch.column(2).to_pylist()], tree)
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
