"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element and every run of text beside blocks is a node. Trees score how likely a node holds part of the main
text, from its tag, attribute tokens, subtree density, depth and siblings, and from its ancestors. Decoding finds the most
likely labelling in which no node is kept below a dropped one. The trees learn from pages that are composed here, with
known main text, in many layouts; ``TRAIN_PAGES`` bounds their number.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.llm.common import small_batches

TRAIN_PAGES = 1200
TREES, DEPTH, RATE = 60, 4, 0.25
#: Private characters around the main text of composed pages.
MARKS = ("\ue000", "\ue001")
BINS = 24

#: A tag whose quoted values may hold ``>``, and what is left of that where quotes don't pair up.
_BROKEN_TOKEN = r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>"
_TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|" + _BROKEN_TOKEN, re.S)
_BROKEN_TOKEN = re.compile(_BROKEN_TOKEN, re.S)
#: Lengths of a page that tags with quotes that don't pair up may be looked through in vain; later tags end at their first ``>``.
_VAIN = 16
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of HTML by their role. Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template noscript iframe svg math object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body button caption html head label option optgroup tbody td tfoot th thead tr legend".split())
_SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TAGS = ("#text", "p", "h", "div", "li", "list", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "cell", "figure", "quote", "control", "other")
_TAG_OF = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dd": "li", "dt": "li", "td": "cell", "th": "cell", "pre": "quote", "blockquote": "quote", "figcaption": "figure", "button": "control", "label": "control", "legend": "control", "fieldset": "form", "search": "form", "dialog": "aside", "hgroup": "h", "details": "div", "center": "div"}
#: Parts of class names, identifiers and roles, by what they tell.
_GROUPS = (
    frozenset("article content contents post entry story body text main maincontent prose page blog news".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs sitemap pagination pager toc tabs topbar toolbar links".split()),
    frozenset("header head masthead logo brand sitename".split()),
    frozenset("footer foot bottom copyright legal colophon imprint".split()),
    frozenset("sidebar side aside widget widgets related recommended trending popular teaser rail secondary complementary".split()),
    frozenset("ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored sponsors dfp doubleclick affiliate".split()),
    frozenset("notice cookie cookies consent gdpr alert warning message popup modal overlay newsletter subscribe subscription paywall toast dialog disclaimer".split()),
    frozenset("comment comments reply replies discussion disqus respond reader readers review reviews feedback thread commentlist".split()),
    frozenset("form login signin search signup register share sharing social follow contact author byline meta tags vote poll".split()),
)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    groups: int = 0
    hidden: bool = False
    pieces: list = field(default_factory=list)  # direct text, and child numbers where blocks stand
    link: int = 0  # characters of direct text in links
    tags: int = 0


def _attributes(raw: str) -> tuple[int, bool]:
    """(groups of the attribute tokens as bits, whether the element is hidden)."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return 0, False
    groups, hidden = 0, False
    for name, *values in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for part in _PART.findall(value):
                part = part.lower()
                for k, group in enumerate(_GROUPS):
                    if part in group:
                        groups |= 1 << k
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return groups, hidden


class _Open:
    """The open elements, inline ones too, with the block that each belongs to; the nearest one of a name is looked up, not searched for."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def owner(self) -> int:
        return self.stack[-1][1]

    def nearest(self, names) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def push(self, name: str, owner: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, owner))

    def close(self, to: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.stack) > to:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()


def parse(page: str) -> list[Node]:
    """Block nodes of a page, parents before children; inline markup is left out, its text goes to the block around it.

    The time is linear in the page, whatever is broken in it.
    """
    nodes = [Node("#root", -1, 0)]
    opened = _Open()
    n, last, vain = len(page), page.rfind(">"), _VAIN * len(page)
    begin = at = 0  # where the text that is not yet in a node begins, and where to go on

    def text(raw: str) -> None:
        if raw:
            node = nodes[opened.owner]
            node.pieces.append(raw)
            if opened.places.get("a"):
                node.link += len(raw.strip())

    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            # No tag ends from here on; a comment may begin.
            comment = page.find("<!--", lt) if lt >= 0 else -1
            text(page[begin : comment if comment >= 0 else n])
            break
        m = (_TOKEN if vain >= 0 else _BROKEN_TOKEN).match(page, lt)
        if m is None:
            at = lt + 1
            continue
        text(page[begin:lt])
        begin = at = m.end()
        if m.re is _BROKEN_TOKEN:
            ending, name, raw = m[1], m[2], m[3]
        elif m[2]:
            ending, name, raw = m[1], m[2], m[3]
        else:
            ending, name, raw = m[4], m[5], m[6]
            vain -= (n - lt) if name else 0
        if not name:
            continue
        name, raw = name.lower(), raw or ""
        if ending:
            place = opened.nearest((name,))
            if place > (0 if name in _BLOCK else opened.blocks[-1]):  # an inline end tag doesn't close blocks
                opened.close(place)
            continue
        nodes[opened.owner].tags += 1
        if name in _RAW and not raw.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            begin = at = close + 1 if close >= 0 else n
            text(" ")
            continue
        if name in _VOID:
            text(" ")
            continue
        if name in _BLOCK:
            if name in _CLOSES_P and opened.stack[opened.blocks[-1]][0] == "p":
                opened.close(opened.blocks[-1])
            if name in _SELF_CLOSING:
                same, barrier = _SELF_CLOSING[name]
                while (place := opened.nearest(same)) > opened.nearest(barrier):
                    opened.close(place)
                    if opened.stack[-1][0] not in same:
                        break
            owner = opened.owner
            groups, hidden = _attributes(raw)
            nodes[owner].pieces.append(len(nodes))
            nodes.append(Node(name, owner, nodes[owner].depth + 1, groups, hidden or nodes[owner].hidden))
            opened.push(name, len(nodes) - 1)
        else:
            opened.push(name, opened.owner)
    return _with_text_nodes(nodes)


def _squeezed(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _with_text_nodes(nodes: list[Node]) -> list[Node]:
    """Direct text becomes one string at the front of ``pieces``; runs of text beside child blocks become nodes of their own."""
    for k in range(len(nodes)):
        node = nodes[k]
        mixed = any(isinstance(p, int) for p in node.pieces)
        out, run = [], []
        for p in [*node.pieces, None]:
            if isinstance(p, str):
                run.append(p)
                continue
            if run:
                said = _squeezed(run)
                run = []
                if said and mixed:
                    out.append(len(nodes))
                    nodes.append(Node("#text", k, node.depth + 1, 0, node.hidden, [said], min(node.link, len(said))))
                elif said:
                    out.append(said)
            if p is not None:
                out.append(p)
        node.pieces = out
    return nodes


N_OWN = 14
#: Own figures, tag, attribute groups, groups of the ancestors, tags of the ancestors.
WIDTH = N_OWN + len(_TAGS) + 2 * len(_GROUPS) + len(_TAGS)
_TAG_INDEX = {t: k for k, t in enumerate(_TAGS)}


def _tag_index(tag: str) -> int:
    return _TAG_INDEX.get(_TAG_OF.get(tag, tag), len(_TAGS) - 1)


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    order = sorted(range(n), key=lambda k: nodes[k].depth)
    chars, words, link, tags, marks, paragraphs = np.zeros((6, n))
    for k, node in enumerate(nodes):
        if node.pieces and isinstance(node.pieces[0], str):
            said = node.pieces[0]
            chars[k], words[k], marks[k] = len(said), said.count(" ") + 1, sum(map(said.count, ".,!?;:"))
            paragraphs[k] = node.tag == "p"
        link[k], tags[k] = min(node.link, chars[k]) if node.tag != "#text" else node.link, node.tags + 1
    own = chars.copy()
    parent = np.array([node.parent for node in nodes])
    for k in reversed(order[1:]):
        p = parent[k]
        for x in (chars, words, link, tags, marks, paragraphs):
            x[p] += x[k]
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    out = np.zeros((n, WIDTH), np.float32)
    total = max(chars[0], 1.0)
    before = np.zeros(n)
    place = np.zeros(n)
    same = np.zeros(n)
    for k, node in enumerate(nodes):
        kinds: dict[str, int] = {}
        at, blocks = before[k], [p for p in node.pieces if isinstance(p, int)]
        for i, p in enumerate(blocks):
            before[p], place[p] = at, i
            at += chars[p]
            kinds[nodes[p].tag] = kinds.get(nodes[p].tag, 0) + 1
        for p in blocks:
            same[p] = kinds[nodes[p].tag]
    up = np.maximum(parent, 0)
    out[:, :N_OWN] = np.stack(
        [np.log1p(chars), link / np.maximum(chars, 1), chars / np.maximum(tags, 1), marks / np.maximum(words, 1), np.log1p(paragraphs), chars / np.maximum(paragraphs, 1), np.array([x.depth for x in nodes]),
         children, place, same, chars / np.maximum(chars[up], 1), before / total, chars / total, own / np.maximum(chars, 1)], axis=1)
    base = N_OWN + len(_TAGS)
    for k in order:
        node = nodes[k]
        out[k, N_OWN + _tag_index(node.tag)] = 1
        for g in range(len(_GROUPS)):
            out[k, base + g] = node.groups >> g & 1
        if k:
            p = node.parent
            out[k, base + len(_GROUPS) :] = out[p, base + len(_GROUPS) :]
            out[k, base + len(_GROUPS) : base + 2 * len(_GROUPS)] += out[p, base : base + len(_GROUPS)]
            out[k, base + 2 * len(_GROUPS) + _tag_index(nodes[p].tag)] += 1
    return out


@dataclass
class Forest:
    """Trees of equal depth: at each inner node a feature and a threshold, at each leaf a value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Forest:
    """Gradient boosting with the logistic loss; splits are sought among at most ``BINS`` quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, values = [], [], []
    offset = np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * BINS) + offset[None, :] + bins).ravel()
            size = count * width * BINS
            sg = np.bincount(cell, np.repeat(g, width), size).reshape(count, width, BINS).cumsum(2)
            sh = np.bincount(cell, np.repeat(h, width), size).reshape(count, width, BINS).cumsum(2)
            all_g, all_h = sg[:, :1, -1:], sh[:, :1, -1:]
            gain = sg**2 / (sh + 1) + (all_g - sg) ** 2 / (all_h - sh + 1) - all_g**2 / (all_h + 1)
            gain[(sh < 2) | (all_h - sh < 2)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-3 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(start, np.array(features), np.array(thresholds), np.array(values))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely labels in which a kept node's ancestors are kept; hidden nodes are dropped."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    order = sorted(range(len(nodes)), key=lambda k: nodes[k].depth)
    keep, drop = yes.copy(), no.copy()
    for k in reversed(order[1:]):
        p = nodes[k].parent
        if nodes[k].hidden:
            keep[k] = -1e9
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(len(nodes), bool)
    for k in order:
        kept[k] = (k == 0 or kept[nodes[k].parent]) and keep[k] > drop[k]
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Text of the kept nodes in page order, with a blank between blocks."""
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif kept[k]:
            todo += reversed(nodes[k].pieces)
    return " ".join(out)


class _Composer:
    """Random pages with known main text. Words are made up of syllables; the layouts follow common practice."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.marked: list[str] = []

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def maybe(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, n: int) -> str:
        return " ".join("".join(self.pick("ta", "re", "mi", "on", "the", "er", "li", "so", "nu", "ka", "ing", "st", "o", "a") for _ in range(int(self.r.integers(1, 5)))) for _ in range(max(1, n)))

    def sentence(self) -> str:
        return self.words(int(self.r.integers(3, 16))).capitalize() + self.pick(".", ".", ".", "!", "?")

    def prose(self, mean: float) -> str:
        out = " ".join(self.sentence() for _ in range(1 + int(self.r.geometric(1 / mean))))
        return out if self.maybe(0.8) else out.replace(" ", self.pick(" ", " &amp; ", "### ", " | "))

    def attr(self, *tokens: str, p: float = 0.85) -> str:
        if not self.maybe(p):
            return ""
        name = self.pick("class", "class", "id", "class")
        return f' {name}="{self.pick("", "", "site-", "c-", "js ", "col ")}{self.pick(*tokens)}{self.pick("", "", "-inner", "-box", " wide", "_1")}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.words(int(self.r.integers(1, 4)))}</a>' for k in range(n)]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.maybe(0.7) else self.pick(" | ", " ").join(items)

    def noise(self) -> str:
        kind = self.pick("nav", "ad", "aside", "notice", "form", "share", "script", "ad", "related")
        said = self.sentence() if self.maybe(0.6) else self.prose(2)
        wrap = lambda x: x if self.maybe(0.5) else f"<p>{x}</p>"
        if kind == "nav":
            tag = self.pick("nav", "div", "nav")
            return f"<{tag}{self.attr('nav', 'menu', 'navbar', 'breadcrumbs', p=0.4 if tag == 'nav' else 1)}>{self.links(int(self.r.integers(3, 12)))}</{tag}>"
        if kind == "ad":
            tag = self.pick("div", "div", "section", "aside")
            return f"<!-- ad --><{tag}{self.attr('ad', 'ads', 'advert', 'banner', 'promo', 'sponsored', 'ad-slot', p=1)}>{wrap(said)}</{tag}>"
        if kind == "aside":
            tag = self.pick("aside", "div")
            return f"<{tag}{self.attr('sidebar', 'widget', 'side', 'rail', p=0.5 if tag == 'aside' else 1)}><h3>{self.words(2)}</h3>{wrap(said)}{self.links(4) if self.maybe(0.5) else ''}</{tag}>"
        if kind == "notice":
            return f"<div{self.attr('cookie-notice', 'notice', 'consent', 'alert', 'newsletter', 'subscribe', 'popup', p=1)}>{wrap(said)}<button>{self.words(1)}</button></div>"
        if kind == "form":
            return f"<form{self.attr('search', 'login', 'signup', p=0.5)}><label>{self.words(2)}</label><input name=q>{wrap(said) if self.maybe(0.5) else ''}<button>{self.words(1)}</button></form>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'tags', 'follow', p=1)}>{self.links(4)}</div>"
        if kind == "related":
            return f"<{(t := self.pick('div', 'section', 'aside'))}{self.attr('related', 'recommended', 'popular', 'teaser', p=1)}><h2>{self.words(2)}</h2>{''.join(f'<div><a href=x>{self.words(5)}</a><p>{self.sentence()}</p></div>' for _ in range(3))}</{t}>"
        return f'<script>var t="</p>";x({self.words(2)!r});</script><style>p{{margin:0}}</style>'

    def block(self) -> str:
        """A block of the main text, bare of other content."""
        kind = self.r.random()
        said = self.prose(3) if self.maybe(0.75) else self.words(int(self.r.integers(1, 4))).capitalize() + "."
        if kind < 0.72:
            if self.maybe(0.12):
                said = f'{said} <a href="/x">{self.words(2)}</a> {self.sentence()}'
            if self.maybe(0.12):
                said = f"<b>{said}<br>" if self.maybe(0.5) else f"<em>{said}</em>"
            return f"<p>{said}" + ("</p>" if self.maybe(0.9) else "")
        if kind < 0.82:
            return f"<h{(k := int(self.r.integers(2, 5)))}>{self.words(4)}</h{k}>"
        if kind < 0.88:
            return f"<ul>{''.join(f'<li>{self.sentence()}</li>' for _ in range(int(self.r.integers(2, 6))))}</ul>"
        if kind < 0.93:
            return f"<blockquote>{self.sentence()}</blockquote>"
        if kind < 0.96:
            return f"<table><tr><td>{self.words(3)}</td><td>{self.words(2)}</td></tr></table>"
        return f"<div>{self.prose(3)}</div>"

    def comments(self) -> str:
        each = "".join(f"<{(t := self.pick('div', 'li', 'article'))}{self.attr('comment', 'reply', p=0.6)}><b>{self.words(2)}</b><p>{self.prose(2)}</p></{t}>" for _ in range(int(self.r.integers(1, 7))))
        tag = self.pick("div", "section", "ol", "aside")
        return f"<{tag}{self.attr('comments', 'comment-list', 'discussion', 'replies', 'reader-comments', 'respond', 'disqus', p=1)}><h3>{self.words(2)}</h3>{each}</{tag}>"

    def page(self) -> str:
        """The page; what is between the two ``MARKS`` is main text."""
        title = self.words(5).capitalize()
        if self.maybe(0.3):  # little more than a heading
            blocks = [f"<p>{self.words(int(self.r.integers(1, 6))).capitalize()}.</p>" for _ in range(int(self.r.integers(1, 3)))]
        else:
            blocks = [self.block() for _ in range(1 + int(self.r.geometric(0.12)))]
        inner = MARKS[0] + (f"<h1>{title}</h1>" if self.maybe(0.8) else "") + MARKS[1]
        for b in blocks:
            inner += MARKS[0] + b + MARKS[1] + (self.noise() if self.maybe(0.06) else "")
        shell = self.pick("article", "article", "main", "div", "div", "section", "article")
        body = f"<{shell}{self.attr('article', 'content', 'post', 'entry', 'story', 'main', 'text', 'prose', p=0.4 if shell != 'div' else 0.8)}>{inner}</{shell}>"
        if self.maybe(0.4):
            extra = self.comments() if self.maybe(0.5) else self.noise()
            body = f"<{(t := self.pick('main', 'div', 'div'))}{self.attr('content', 'wrapper', 'container', 'main', 'page', p=0.6)}>{self.noise() if self.maybe(0.4) else ''}{body}{extra}</{t}>"
        head = f"<header{self.attr('header', 'masthead', p=0.4)}><div>{self.words(2)}</div>{self.links(5) if self.maybe(0.5) else ''}</header>" if self.maybe(0.5) else ""
        foot = f"<{(t := self.pick('footer', 'footer', 'div'))}{self.attr('footer', 'copyright', p=0.4 if t == 'footer' else 1)}>&copy; {self.words(2)} &middot; {self.sentence()}{self.links(4) if self.maybe(0.4) else ''}</{t}>" if self.maybe(0.85) else ""
        before = "".join(self.noise() for _ in range(int(self.r.integers(0, 4))))
        after = "".join(self.comments() if self.maybe(0.3) else self.noise() for _ in range(int(self.r.integers(0, 4))))
        end = "</body></html>" if self.maybe(0.9) else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>x()</script></head><body>{head}{before}{body}{after}{foot}{end}"


def training_nodes(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the nodes of a composed page; a node's label says whether main text is in its subtree."""
    page = _Composer(seed).page()
    nodes = parse(page)
    inside, state = np.zeros(len(nodes), bool), [False]

    def walk(k: int) -> None:
        for p in nodes[k].pieces:
            if isinstance(p, int):
                walk(p)
                inside[k] |= inside[p]
            else:
                for c in p:
                    if c == MARKS[0]:
                        state[0] = True
                    elif c == MARKS[1]:
                        state[0] = False
                    elif state[0] and not c.isspace():
                        inside[k] = True

    walk(0)
    # The marks are text of their own; without them a block may hold nothing, so the features come from the clean page.
    clean = parse(page.replace(MARKS[0], "").replace(MARKS[1], ""))
    if len(clean) == len(nodes):
        return node_features(clean), inside.astype(float)
    # Marks beside blocks made nodes of their own, all after the elements: drop them in order.
    marks = [k for k, x in enumerate(nodes) if x.tag == "#text" and not x.pieces[0].strip(" " + "".join(MARKS))]
    keep = np.setdiff1d(np.arange(len(nodes)), marks)
    if len(keep) != len(clean) or any(nodes[a].tag != b.tag for a, b in zip(keep, clean)):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    return node_features(clean), inside[keep].astype(float)


def train(spark: SparkSession, pages: int = TRAIN_PAGES) -> Forest:
    """Trees from ``pages`` composed pages, which the executors compose and parse."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seed in frame["id"]:
                x, y = training_nodes(int(seed))
                rows.append((int(seed), x.astype(np.float32).tobytes(), y.astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "x", "y"])

    got = spark.range(pages, numPartitions=8).mapInPandas(make, "id long, x binary, y binary").toPandas().sort_values("id")
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]])
    y = np.concatenate([np.frombuffer(b, np.float32) for b in got["y"]])
    return boost(x, y.astype(float))


def extract_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """Main texts; nodes of some pages are scored at once."""
    out: list[str] = []
    for a in range(0, len(pages), 64):
        parsed = [parse(p or "") for p in pages[a : a + 64]]
        features = [node_features(x) for x in parsed]
        odds = forest.log_odds(np.concatenate(features))
        ends = np.cumsum([len(x) for x in parsed])
        out += [text_of(x, decode(x, o)) for x, o in zip(parsed, np.split(odds, ends[:-1]))]
    return out


def html_extract(pages: DataFrame, forest: Forest, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page; null and empty pages, and pages without main text, have an empty one."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(extract_texts(batch.tolist(), forest), dtype=object)

    return pages.withColumn(out_col, extracted(F.col(html_col)))


def op2_query(pages: DataFrame) -> DataFrame:
    found = html_extract(pages.select("page_id", "url", "html"), train(pages.sparkSession))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
