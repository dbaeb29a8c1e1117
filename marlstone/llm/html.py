"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element is a node with a hidden label, content or not. A node's
features give it a potential, and each parent-child pair has a 2x2 potential by
the kind of child. Sum-product messages, upward then downward, give every
node's exact content marginal; weights maximise the likelihood of labelled
pages. The text of nodes with a marginal over one half is the main text.

Features are what a node is (its element, words in its class, id and role), what
it holds (links, sentences, headings, its share of the page's text) and where it
stands (inside or outside the page's article, depth, before or after most text,
next to links). No single one of them decides.

The labelled pages are made from the layouts in `LAYOUTS` with a fixed seed; their
classes are known words, unknown ones or none, and such as tell of something else.
``fit`` takes any others in the same form (html with ``data-keep`` marks).
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import Markup

#: Elements that start a block of their own. Everything else is inline.
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hgroup dialog menu center".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = set("head script style noscript template svg annotation annotation-xml object iframe canvas audio video select option datalist button textarea title".split())
#: What can stand in a head. Any other start tag ends it, and so does text, as its end tag and the body's start tag can be left out.
IN_HEAD = set("head html title meta link base script style noscript template".split())
#: A start tag that ends an open element of its kind: kind -> where the search for it stops.
CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: The kinds that such a tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_PARTS = re.compile(r"[a-z]+")
#: Words in class, id and role that tell what an element is for.
MARKS = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "toolbar"},
    "frame": {"header", "footer", "masthead", "banner", "topbar", "copyright", "colophon"},
    "side": {"sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "teaser", "share", "social", "promo", "newsletter", "subscribe", "signup"},
    "advert": {"ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsor", "sponsored", "dfp", "promoted"},
    "notice": {"cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "notification", "paywall", "dialog"},
    "reader": {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "commentlist"},
    "body": {"article", "content", "main", "post", "entry", "story", "body", "text", "prose"},
}
#: Parts of a class name that make it a state: it says what an element has, not what it is.
STATES = {"has", "is", "no", "not", "with", "without", "hide", "show", "status", "enabled", "disabled", "open", "opened", "closed", "active", "type", "format", "style", "layout", "template", "single", "count", "allowed", "free"}
_TAGS = ["article", "main", "section", "div", "p", "heading", "list", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "body", "other"]
_TAG_OF = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "td": "table", "th": "table", "tr": "table", "thead": "table", "tbody": "table", "tfoot": "table", "caption": "table", "blockquote": "quote", "pre": "quote", "figcaption": "quote", "fieldset": "form", "dialog": "aside", "html": "body"}
#: Of the text: share of links in it and of sentences, headings in it, and its share of the page's text outside links.
TEXT = ["links", "linky", "stops", "headed", "share", "most", "little"]
#: Of the place: in the article, outside of one that the page has, marks inside an article, depth, text before and after, links beside it,
#: a box beside one with most of the page's text, or in such a box.
PLACE = ["inside", "outside", "header_inside", "marked_inside", "mixed", "depth", "early", "late", "by_links", "beside_most", "link_box", "in_beside"]
FEATURES = [*_TAGS, *MARKS, *TEXT, *PLACE, "hidden", "bias"]
_LEAVES = {"p", "li", "dt", "dd", "tr", "td", "th"}
_BOXES = {"div", "section", "article", "main", "ul", "ol", "td", "center", "menu", "dl", "table", "body"}
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Kinds of child for the pair potentials.
EDGES = ["frame", "marked", "inner"]
_STOP = re.compile(r"[.!?…。！？؟।](?:\s|$)")


def marks_of(attrs: dict[str, str]) -> set[str]:
    """What class, id and role say: of each name its kinds, state names left out; a part that is no content overrules one that is."""
    out: set[str] = set()
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().split():
        parts = set(_PARTS.findall(name))
        if len(parts) > 1 and parts & STATES:
            continue
        own = {k for k, v in MARKS.items() if parts & v}
        out |= own - {"body"} or own
    return out


class Node:
    __slots__ = ("tag", "parent", "children", "marks", "hidden", "chars", "linked", "stops", "keep")

    def __init__(self, tag: str, parent: int, attrs: dict[str, str]):
        self.tag, self.parent, self.children = tag, parent, []
        self.marks = marks_of(attrs) if attrs else set()
        self.hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        self.chars = self.linked = self.stops = 0
        self.keep = attrs.get("data-keep")

    def plain_leaf(self, tag: str) -> bool:
        return self.tag == tag and tag in _LEAVES and not (self.children or self.marks or self.hidden or self.keep)


class Tree(Markup):
    """Block nodes of a page, parents first, and its shown text as (node, piece); None marks a break.

    A run of unmarked leaves of one kind - paragraphs, list items - is one
    node: a hundred paragraphs are not a hundred independent witnesses.
    """

    def __init__(self, html: str):
        self.nodes = [Node("html", -1, {})]
        self.stack = [0]
        self.open = Counter()
        self.text: list[tuple[int, str | None]] = []
        self.skip: list[str] = []
        self.links = 0
        self.read(html)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1] != "head":
                self.skip.append(tag)
            elif self.skip[0] == "head" and (tag == "body" or self.skip[-1] in ("head", "title") and tag not in IN_HEAD):
                self.skip.clear()
            if self.skip and (tag not in HIDDEN or self.skip != ["head"] or tag == "head"):
                return
        if tag in HIDDEN:
            self.skip.append(tag)
        elif tag == "br" or tag == "hr":
            self.text.append((self.stack[-1], None))
        elif tag == "a":
            self.links += 1
        elif tag in BLOCKS and tag != "html":
            if tag == "body" and self.open["body"]:
                return
            if tag != "body":
                self._body()
            self._imply(tag)
            node, family = Node(tag, self.stack[-1], attrs), self.nodes[self.stack[-1]].children
            if family and self.nodes[family[-1]].plain_leaf(tag) and node.plain_leaf(tag):
                self.stack.append(family[-1])
            else:
                self.nodes.append(node)
                family.append(len(self.nodes) - 1)
                self.stack.append(len(self.nodes) - 1)
            self.open[tag] += 1
            self.text.append((self.stack[-1], None))

    def _body(self) -> None:
        """The body that a page without the tag has."""
        if len(self.nodes) == 1:
            self.nodes.append(Node("body", 0, {}))
            self.nodes[0].children.append(1)
            self.stack.append(1)
            self.open["body"] += 1

    def _imply(self, tag: str) -> None:
        if self.nodes[self.stack[-1]].tag == "p":
            self._pop(len(self.stack) - 1)
        if any(self.open[t] for t in ENDS.get(tag, ())):
            for k in range(len(self.stack) - 1, 0, -1):
                t = self.nodes[self.stack[k]].tag
                if t in ENDS[tag]:
                    self._pop(k)
                    break
                if t in CLOSES[tag]:
                    break

    def _pop(self, k: int) -> None:
        self.open.subtract(self.nodes[i].tag for i in self.stack[k:])
        del self.stack[k:]
        self.links = 0
        self.text.append((self.stack[-1], None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.skip:
            self.skip.pop()

    def handle_endtag(self, tag):
        if self.skip:
            if tag == "head" == self.skip[0]:
                self.skip.clear()
            elif tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif self.open[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.nodes[self.stack[k]].tag == tag:
                    self._pop(k)
                    break

    def handle_data(self, data):
        if self.skip == ["head"] and not data.isspace():
            self.skip.clear()
        if not self.skip and data:
            if not data.isspace():
                self._body()
            i = self.stack[-1]
            self.text.append((i, data))
            n = self.nodes[i]
            size = len(data.strip())
            n.chars += size
            n.linked += size if self.links else 0
            n.stops += 0 if self.links else len(_STOP.findall(data))


def _vectors(t: Tree) -> tuple[np.ndarray, list[int]]:
    n = len(t.nodes)
    x = np.zeros((n, len(FEATURES)))
    total = [k.chars for k in t.nodes]
    linked = [k.linked for k in t.nodes]
    stops = [k.stops for k in t.nodes]
    headed = [_TAG_OF.get(k.tag) == "heading" for k in t.nodes]
    core = [k.tag in ("article", "main") for k in t.nodes]  # holds one
    for i in range(n - 1, 0, -1):
        p = t.nodes[i].parent
        total[p] += total[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        headed[p] = headed[p] or headed[i]
        core[p] = core[p] or core[i]
    plain = max(1, total[0] - linked[0])
    within = [False] * n
    depth = [0] * n
    before = [0] * n  # characters of the page before the node's own
    seen = 0
    kinds = []
    for i, k in enumerate(t.nodes):
        p = k.parent
        within[i] = k.tag in ("article", "main") or (p >= 0 and within[p])
        depth[i] = depth[p] + 1 if p >= 0 else 0
        before[i], seen = seen, seen + k.chars
        tag = _TAG_OF.get(k.tag, k.tag)
        v = x[i]
        v[_AT[tag if tag in _TAGS else "other"]] = 1
        for m in k.marks:
            v[_AT[m]] = 1
        bad = k.hidden or bool(k.marks - {"body"})
        of_links = linked[i] / total[i] if total[i] else 0.0
        share = (total[i] - linked[i]) / plain
        v[_AT["links"]], v[_AT["linky"]] = of_links, of_links > 0.5
        v[_AT["stops"]] = min(1.0, 60 * stops[i] / (total[i] - linked[i] + 1))
        v[_AT["headed"]] = headed[i]
        v[_AT["share"]], v[_AT["most"]], v[_AT["little"]] = share, share > 0.5, share < 0.1
        v[_AT["inside"]], v[_AT["outside"]] = within[i], core[0] and not (within[i] or core[i])
        inner = p >= 0 and within[p]
        v[_AT["header_inside"]] = inner and headed[i] and (tag == "header" or "frame" in k.marks)
        v[_AT["marked_inside"]] = inner and bad
        v[_AT["mixed"]] = bad and "body" in k.marks
        v[_AT["depth"]] = min(depth[i], 12) / 12
        v[_AT["early"]] = before[i] < 0.1 * total[0] and share < 0.5
        v[_AT["late"]] = before[i] > 0.9 * total[0]
        v[_AT["hidden"]], v[_AT["bias"]] = k.hidden, 1
        kinds.append(0 if tag in ("nav", "header", "footer", "aside", "form") else 1 if bad else 2)
    text = [a - b for a, b in zip(total, linked)]
    for i, k in enumerate(t.nodes):
        boxes = [c for c in k.children if t.nodes[c].tag in _BOXES]
        most = max(boxes, key=lambda c: text[c], default=-1)
        for c in boxes:
            x[c, _AT["beside_most"]] = c != most and text[most] > 0.4 * plain and text[c] < 0.25 * text[most]
            x[c, _AT["link_box"]] = x[c, _AT["linky"]] and not stops[c]
        for c in k.children:
            x[c, _AT["in_beside"]] = max(x[i, _AT["beside_most"]], x[i, _AT["in_beside"]])
        for a, b in zip(k.children, k.children[1:]):
            x[a, _AT["by_links"]] = max(x[a, _AT["by_links"]], x[b, _AT["linky"]])
            x[b, _AT["by_links"]] = max(x[b, _AT["by_links"]], x[a, _AT["linky"]])
    return x, kinds


def _log_sum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def marginals(nodes: list[Node], unary: list[float], kinds: list[int], pair: list[list[list[float]]]):
    """Content marginals, pair marginals P(parent, child) and log partition by sum-product on the tree.

    ``unary`` is the log potential of content against 0 for the rest.
    Nodes come parents first, so one pass back sends all messages up and one
    pass forth all messages down.
    """
    n = len(nodes)
    up = [[0.0, u] for u in unary]  # belief of the subtree below, by label
    sent = [[0.0, 0.0] for _ in range(n)]  # message to the parent
    for i in range(n - 1, 0, -1):
        w = pair[kinds[i]]
        for y in (0, 1):
            sent[i][y] = _log_sum(w[y][0] + up[i][0], w[y][1] + up[i][1])
            up[nodes[i].parent][y] += sent[i][y]
    log_z = _log_sum(up[0][0], up[0][1])
    full = [row[:] for row in up]
    pairs = [None] * n
    for i in range(1, n):
        p, w = nodes[i].parent, pair[kinds[i]]
        rest = [full[p][y] - sent[i][y] for y in (0, 1)]
        joint = [[rest[y] + w[y][c] + up[i][c] for c in (0, 1)] for y in (0, 1)]
        full[i] = [_log_sum(joint[0][c], joint[1][c]) for c in (0, 1)]
        pairs[i] = [[math.exp(joint[y][c] - log_z) for c in (0, 1)] for y in (0, 1)]
    return [math.exp(f[1] - log_z) for f in full], pairs, log_z


def _depths(parent: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth but the first; parents come before their children."""
    depth = np.zeros(len(parent), dtype=np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    return [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]


def forest_marginals(parent: np.ndarray, depths: list[np.ndarray], unary: np.ndarray, kinds: np.ndarray, pair: np.ndarray):
    """`marginals` of many trees at once, one step a depth: content marginals and pair marginals (nodes, 2, 2)."""
    n = len(parent)
    up = np.stack([np.zeros(n), unary], axis=1)
    sent = np.zeros((n, 2))
    for at in reversed(depths):
        sent[at] = np.logaddexp.reduce(pair[kinds[at]] + up[at][:, None, :], axis=2)
        np.add.at(up, parent[at], sent[at])
    log_z = np.logaddexp(up[:, 0], up[:, 1])  # of the tree, where the node is a root
    full = up.copy()
    joint = np.full((n, 2, 2), -np.inf)
    for at in depths:
        p = parent[at]
        joint[at] = (full[p] - sent[at])[:, :, None] + pair[kinds[at]] + up[at][:, None, :]
        full[at] = np.logaddexp(joint[at][:, 0], joint[at][:, 1])
        log_z[at] = log_z[p]
    return np.exp(full[:, 1] - log_z), np.exp(joint - log_z[:, None, None])


def fit(pages: Iterable[str], rounds: int = 500, rate: float = 0.1, penalty: float = 0.0005) -> tuple[list[float], list[list[list[float]]]]:
    """Unary weights and pair potentials by gradient ascent (with moments) on the likelihood of labelled pages.

    An element's ``data-keep`` ("1" or "0") labels it and everything in it that
    has no mark of its own. Every page counts the same, whatever its size.
    """
    parent, xs, kind, label, share, size = [], [], [], [], [], 0
    for html in pages:
        t = Tree(html)
        x, kinds = _vectors(t)
        y: list[int] = []
        for n in t.nodes:
            y.append(int(n.keep) if n.keep is not None else (y[n.parent] if n.parent >= 0 else 0))
        parent += [n.parent + size if n.parent >= 0 else -1 for n in t.nodes]
        xs.append(x)
        kind += kinds
        label += y
        share += [1 / math.sqrt(len(y))] * len(y)
        size += len(y)
    parent, x, kinds, y, share = np.array(parent), np.concatenate(xs), np.array(kind), np.array(label), np.array(share)
    depths, count = _depths(parent), len(xs)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((len(EDGES), 2, 2))
    np.add.at(seen, (kinds[child], y[parent[child]], y[child]), share[child])
    width = len(FEATURES)
    theta = np.zeros(width + len(EDGES) * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, pair = theta[:width], theta[width:].reshape(-1, 2, 2)
        m, both = forest_marginals(parent, depths, x @ w, kinds, pair)
        gp = seen - penalty * count * pair
        np.subtract.at(gp, kinds[child], share[child][:, None, None] * both[child])
        g = np.concatenate([x.T @ (share * (y - m)) - penalty * count * w, gp.ravel()]) / count
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        theta = theta + rate * (1 - k / (rounds + 1)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta[:width].tolist(), theta[width:].reshape(-1, 2, 2).tolist()


#: Page layouts for the labelled pages: K keeps, D drops; {p} paragraphs, {s} short text, {l} links, {i} list items;
#: {body}, {menu} and so on stand for a class of that kind, {odd} for one that is no known word.
LAYOUTS = [
    '<nav {D}><ul>{l}</ul></nav><div {advert} {D}>{s}</div><article {K}><h1>{s}</h1>{p}</article><footer {D}>{s}</footer>',
    '<nav {D}><ul>{l}</ul></nav><div {advert} {D}>{p}</div><article {body} {K}><h1>{s}</h1><p>{s}</p><p>{s}</p></article><footer {D}>{s}</footer>',
    '<header {D}><div class="logo">{s}</div><nav>{l}</nav></header><main {K}><h1>{s}</h1>{p}<ul>{i}</ul>{p}<blockquote>{p}</blockquote></main><aside {D}><h3>{s}</h3><p>{s}</p>{l}</aside><footer {D}><p>{s}</p></footer>',
    '<div {notice} {D}><p>{s}</p>{p}</div><div {menu} {D}>{l}</div><div {body} {K}><h2>{s}</h2>{p}<table><tr><td>{s}</td><td>{s}</td></tr></table>{p}</div><div {reader} {D}><h3>{s}</h3><div class="comment">{p}</div><div class="comment"><p>{s}</p></div></div>',
    '<div {D}><ul {menu}>{l}</ul></div><div><div {body} {K}><h1>{s}</h1>{p}<div {advert} {D}>{p}</div>{p}<section id="comments" {D}><ul><li>{p}</li><li>{s}</li></ul></section></div><div {side} {D}>{p}{l}</div></div><div {frame} {D}>{s}</div>',
    '<header {frame} {D}><p>{s}</p></header><article {K}><header {D}><p>{s}</p></header><h1>{s}</h1><div>{p}</div><figure><figcaption>{s}</figcaption></figure><form {D}><p>{s}</p><label>{s}</label></form><div><p>{s}</p>{p}</div><aside {D}>{p}</aside></article><section {side} {D}><h2>{s}</h2>{l}</section><footer {D}>{p}</footer>',
    '<header {D}><h2>{s}</h2><p>{s}</p></header><article {body} {K}><header><h1>{s}</h1></header>{p}<section {odd}><h2>{s}</h2>{p}</section></article><footer {D}>{s}</footer>',
    '<header {D}><p>{s}</p>{l}</header><main {K}><article><header {odd}><h1>{s}</h1><p>{s}</p></header><div {odd}>{p}</div></article></main><footer {D}><p>{s}</p>{l}</footer>',
    '<div {frame} {D}><p>{s}</p></div><section {K}><h1>{s}</h1>{p}<ol>{i}</ol><pre>{s}</pre></section><div {side} {D}><form><p>{p}</p></form></div><div {reader} {D}>{p}</div>',
    '<div {K}><p>{s}</p>{p}<h2>{s}</h2>{p}</div><div {notice} {D}><div><p>{s}</p>{p}</div></div><ul {menu} {D}>{l}</ul>',
    '<main {K}><article {body}><h1>{s}</h1><p>{s}</p><dl><dt>{s}</dt><dd>{p}</dd></dl>{p}<footer {D}><p>{s}</p></footer><div {side} {D}>{l}</div></article><div {advert} {D}><p>{s}</p></div></main><div role="dialog" {notice} {D}>{p}</div>',
    '<p {K}>{s}</p><h3 {K}>{s}</h3><p {K}>{s}</p><footer {D}>{s}</footer><nav {D}>{l}</nav>',
    '<article {K}><h1>{s}</h1><p>{s}</p></article>',
    '<article {K}><p>{s}</p></article>',
    '<header {D}><h1>{s}</h1><p>{s}</p></header><article {K}><h1>{s}</h1>{p}</article><footer {D}><p>{s}</p></footer>',
    '<h1 {K}>{s}</h1>{p}',
    '<div {K}><div><h1>{s}</h1><div>{s}</div><div>{s}</div></div></div>',
    '<div {body} {K}><h1>{s}</h1><p>{s}</p><p>{s}</p></div>',
    '<main {K}><p>{s}</p></main><div {side} {D}><p>{s}</p></div>',
    '<header {D}>{s}</header><div {K}><div><p>{s}</p><ul>{i}</ul></div></div><div {notice} {D}>{s}</div><footer {D}><div>{s}</div></footer>',
    '<div {K}><section {body}><h2>{s}</h2>{p}<h2>{s}</h2><ul>{i}</ul></section></div><div {reader} {D}><h4>{s}</h4><ol><li>{p}</li><li><p>{s}</p></li></ol></div><div {side} {D}><p>{p}</p></div>',
    '{p}',
    '<p {K}>{s}</p>',
    '<div {K}>{s}</div>',
    '<ul {K}>{i}</ul>',
    '<div {odd} {K}><ul>{i}</ul><table><tr><td>{s}</td></tr></table></div>',
    '<nav {D}><ul>{l}</ul></nav>{p}<footer {D}>{s}</footer>',
    '<div {K}><p>{s}</p></div>',
    '<div {odd} {D}>{l}</div><div {odd} {K}><h1>{s}</h1>{b}{p}</div><div {odd} {D}>{s}</div>',
    '<div {odd} {D}><ul>{l}</ul></div><div {odd}><div {odd} {K}><h1>{s}</h1>{b}<div {odd}>{p}</div></div><div {odd} {D}><h3>{s}</h3><ul>{l}</ul></div></div><div {odd} {D}><p>{c}</p></div>',
    '<div {odd} {D}>{a}</div><article {body} {K}><h1>{s}</h1>{b}</article><div {odd} {D}>{c}</div>',
    '<div {odd} {D}>{a}</div><main {K}><div {odd}><h1>{s}</h1>{b}{p}</div></main><section {odd} {D}><h3>{s}</h3><p>{c}</p>{l}</section>',
    '<div {odd} {D}>{l}</div><article {K}><header><h1>{s}</h1></header>{b}</article><div {odd} {D}><p>{a}</p></div>',
    '<div {odd} {D}><p>{a}</p></div><div {odd} {K}><h1>{s}</h1>{b}</div><div {odd} {D}>{c}</div>',
    '<div {odd} {D}>{l}</div><div {odd} {K}>{b}</div><div {odd} {D}><h3>{s}</h3><ul>{l}</ul></div>',
    '<table><tr><td {D}><ul>{l}</ul></td><td {K}><h1>{s}</h1>{b}</td></tr></table>',
    '<div {odd} {D}>{l}</div><div {odd}><div {odd} {K}><h2>{s}</h2>{b}</div><div {odd} {D}><h3>{s}</h3>{l}</div></div><div {odd} {D}><h3>{s}</h3><p>{a}</p></div>',
    '<div {odd} {K}><h1>{s}</h1><div {odd}>{b}</div><div {odd}><h2>{s}</h2>{p}</div><div>{p}</div></div>',
    '<div {odd} {K}>{b}</div><div {odd} {K}><h2>{s}</h2>{p}</div><div {odd} {K}>{b}{p}</div>',
    '<div {odd}><div {odd} {D}><a href=/>{s}</a><ul>{l}</ul></div><div {odd} {K}>{b}<div {advert} {D}>{c}</div>{p}</div></div><div {odd} {D}>{c}{l}</div>',
]
#: Other names that an element of a kind may have in a labelled page, beside the words of `MARKS`.
_STATE_NAMES = ["has-sidebar", "share-enabled", "comment-status-open", "no-comments", "with-ads", "type-post", "ad-free", "is-popular"]


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    words_of = {k: sorted(v) for k, v in MARKS.items()}

    def word() -> str:
        return "".join(r.choice("aeiounrstlmd") for _ in range(r.randint(2, 9)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        return " ".join(f"{words(4, 20).capitalize()}{r.choice('...!?')}" for _ in range(r.randint(lo, hi)))

    def named(kind: str) -> str:
        name = word() if kind == "odd" else r.choice(words_of[kind])
        name = r.choice([name, name, f"{word()}-{name}", f"{name}-{word()}", f"{name} {word()}"])
        if kind == "body":
            name = r.choice([name, name, f"{name} {r.choice(_STATE_NAMES)}", f"{name} {r.choice(words_of['side'])}", word(), ""])
        if kind == "odd" and r.random() < 0.3:
            return ""
        return f'{r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def fill(m: re.Match) -> str:
        k = m[1]
        if k in "KD":
            return f'data-keep="{int(k == "K")}"'
        if k in MARKS or k == "odd":
            return named(k)
        if k == "p":
            # Any number and length, and sentences that end or not.
            return "".join(f"<p>{r.choice(['', '<b>'])}{words(3, r.choice([12, 60, 250])).capitalize()}{r.choice(['', '', f' <a href=/>{words(1, 4)}</a> and <a href=/>{words(1, 2)}</a>'])}{r.choice(['.', ''])}</p>" for _ in range(r.choice([1, 2, 3, 5, 9])))
        if k == "b":
            return "".join(f"<p>{sentences(2, 8)}</p>" for _ in range(r.randint(2, 6)))
        if k == "l":
            tag = r.choice(["li", "li", "span"])
            return " ".join(f"<{tag}><a href=/>{words(1, 3)}</a></{tag}>" for _ in range(r.randint(2, 7)))
        if k == "i":
            return "".join(f"<li>{words(3, 20)}</li>" for _ in range(r.randint(2, 5)))
        if k == "a":
            return r.choice([words(2, 9), sentences(1, 1), f"<a href=/>{words(2, 9)}</a>"])
        if k == "c":
            return r.choice([words(1, 6), f"&copy; {words(2, 5)}", sentences(1, 1)])
        return words(1, 9)

    return [f"<html><head><title>{words(2, 6)}</title></head><body data-keep=1>{re.sub(r'{(\w+)}', fill, LAYOUTS[i % len(LAYOUTS)])}</body></html>" for i in range(n)]


@functools.cache
def default_model():
    return fit(labelled_pages())


def main_text(html: str | None, model) -> str:
    """The page's main text: kept blocks in page order, white space as one space."""
    if not html:
        return ""
    t = Tree(html)
    w, pair = model
    x, kinds = _vectors(t)
    m, _, _ = marginals(t.nodes, (x @ np.array(w)).tolist(), kinds, pair)
    pieces = []
    for i, s in t.text:
        if s is None:
            pieces.append(" ")
        elif m[i] > 0.5 or len(t.nodes) <= 2:
            pieces.append(s)
    return " ".join("".join(pieces).split())


def extract(pages: DataFrame, model=None) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null and empty html give an empty text. A page without any block element
    but its body is its shown text. Broken markup is read as far as it goes: what is open at
    the end is closed. Repeated rows come out as often; other columns are ignored.
    """
    model = model or default_model()

    def run(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py(), model) for h in html], pa.string())

    return pages.select("page_id", "url", F.arrow_udf(run, "string")("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
