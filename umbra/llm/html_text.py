"""Main text of HTML pages by a tree-structured graphical model over the DOM.

A page is read by one pass over its tags into a tree (unclosed, stray and implied tags are dealt with;
scripts, styles, comments and the like leave no text). Its nodes are binary variables, content or not: a node potential
from its features (tag, names, own text, links, place) and a parent-child potential, both trained in numpy from the
labelled pages of `labelled_pages`. Sum-product messages pass from the leaves to the root and back, level by level,
which gives each node's exact content marginal; text of a block is kept where its node's marginal is 1/2 or more.

Null, empty and tag-less pages: a page without a body tag is the body itself, and judged like any other; without text
the result is "". White space inside a block is one space, blocks are trimmed and joined by two line ends in page order.
Repeated rows are treated alike; an empty table gives an empty result; extra columns are ignored. Very long pages, also
deeply nested or full of unclosed tags, take time by their length; memory is bounded by one Arrow batch and a page's tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm.labelled_pages import PAGES

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
BODY = re.compile(r"<body\b", re.I)
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page.
SILENT = frozenset("script style noscript template iframe svg math canvas object audio video head title select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: An opening tag ends an open one of the listed kinds.
ENDS = {
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: Tags and words in names that tell; each is a feature.
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table td blockquote pre figure figcaption dl dd body html dialog address".split()
WORDS = (
    "ad ads advert sponsor promo banner nav menu breadcrumb head header foot footer side sidebar aside widget related share social comment comments reply "
    "discuss disqus cookie consent notice alert popup modal newsletter subscribe login form copyright legal article content post entry body main story text tag tags author byline"
).split()
CONTENT_WORDS = frozenset("article content post entry body main story text".split())
_tag = {t: i for i, t in enumerate(TAGS)}
_word = {w: len(TAGS) + i for i, w in enumerate(WORDS)}
SIZE = len(TAGS) + len(WORDS) + 8


@dataclass
class Node:
    tag: str
    names: str
    parent: int
    depth: int
    pieces: list = field(default_factory=list)  # own text in order; None where a block inside breaks it


@dataclass
class Tree:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # (node, text) in page order
    link_chars: list[int]


class Open:
    """The open elements, and what the parser asks of them in constant time."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag and block node
        self.count: Counter[str] = Counter()
        self.blocks = [0]  # places of elements that aren't inline
        self.scopes: list[Counter[str]] = [Counter()]  # open tags since each barrier
        self.silent = self.links = 0

    def push(self, tag: str, node: int) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in _BARRIER:
            self.scopes.append(Counter())
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        if tag in _BARRIER:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        self.count[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        return tag

    def closes(self, tag: str) -> bool:
        """Whether a closing tag ends an element; an inline one ends none outside the nearest barrier."""
        return (self.scopes[-1] if tag in INLINE else self.count)[tag] > 0


def parse(page: str) -> Tree:
    """The page's tree of block elements; inline ones give their text to the block around them. Time grows with the page's length alone."""
    nodes = [Node("", "", -1, 0)]
    open_ = Open()
    blocks: list[tuple[int, str]] = []
    links = [0]
    text: list[str] = []
    own = at = 0
    n = len(page)
    ahead: dict[str, int] = {}  # where the next one of each end mark stands

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                blocks.append((own, whole))
            text.clear()

    def say(begin: int, end: int) -> None:
        if end > begin and not open_.silent:
            text.append(page[begin:end])
            if open_.links:
                links[own] += end - begin

    def find(mark: str, begin: int) -> int:
        """Place of the next mark from begin on, n if there is none; begin never goes back."""
        if ahead.get(mark, -1) < begin:
            ahead[mark] = k if (k := page.find(mark, begin)) >= 0 else n
        return ahead[mark]

    while at < n:
        start = find("<", at)
        say(at, start)
        if start == n:
            break
        if page[start + 1 : start + 2] in ("!", "?"):
            mark = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = find(mark, start + 2 if mark == "-->" else start + 1)
            if end < n and mark == "]]>" and not open_.silent:
                text.append(page[start + 9 : end])
            if end == n:  # no end: the mark of any tag ends it, and without one it is text
                mark, end = ">", find(">", start)
            at = end + len(mark)
            if end == n:
                say(start, start + 1)
                at = start + 1
            continue
        m = TAG.match(page, start)
        if not m:
            say(start, start + 1)
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:  # a closing tag: it ends the nearest open one, and what is open inside
            if tag == "br" or tag == "p" and not open_.count["p"]:
                text.append(" ")
            elif open_.closes(tag):
                before = len(text)
                while True:
                    gone = open_.stack[-1][0]
                    if gone not in INLINE and before:
                        flush()
                        before = 0
                    if open_.pop() == tag:
                        break
                own = open_.stack[-1][1]
            continue
        if tag in ENDS and open_.stack[open_.blocks[-1]][0] in ENDS[tag]:
            flush()
            for _ in range(len(open_.stack) - open_.blocks[-1]):
                open_.pop()
            own = open_.stack[-1][1]
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in INLINE:
            if not m[3].endswith("/"):
                open_.push(tag, own)
            continue
        flush()
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3])) if m[3] else ""
        nodes.append(Node(tag, names, own, nodes[own].depth + 1))
        links.append(0)
        own = len(nodes) - 1
        open_.push(tag, own)
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            if not close:
                break
            at = close.start()
    flush()
    return Tree(nodes, blocks, links)


_BARRIER = frozenset("article aside body div footer header main nav section table td th form ul ol".split())


@lru_cache(maxsize=20_000)
def name_features(tag: str, names: str) -> tuple[int, ...]:
    words = {w for part in re.split(r"[^a-zA-Z]+", names) for w in re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower().split()}
    return tuple([_tag[tag]] if tag in _tag else []) + tuple(sorted(_word[w] for w in words & _word.keys()))


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node features, parents, depths)."""
    n = len(tree.nodes)
    x = np.zeros((n, SIZE), np.float32)
    chars, count = np.zeros(n), np.zeros(n)
    for node, text in tree.blocks:
        chars[node] += len(text)
        count[node] += 1
    links = np.array(tree.link_chars, dtype=float)
    for i, node in enumerate(tree.nodes):
        for f in name_features(node.tag, node.names):
            x[i, f] = 1
    base = len(TAGS) + len(WORDS)
    has = chars > 0
    x[:, base] = 1
    x[:, base + 1] = has
    x[:, base + 2] = np.log1p(chars) / 8
    x[:, base + 3] = np.where(has, np.minimum(links / np.maximum(chars, 1), 1), 0)
    x[:, base + 4] = has & (chars < 40)
    x[:, base + 5] = chars > 200
    x[:, base + 6] = has & (links > 0.5 * chars)
    x[:, base + 7] = np.array([node.depth for node in tree.nodes]) <= 2
    return x, np.array([node.parent for node in tree.nodes]), np.array([node.depth for node in tree.nodes])


def forest(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of several trees, as one set of nodes."""
    parts = [features(t) for t in trees]
    begin = np.cumsum([0, *(len(x) for x, _, _ in parts[:-1])])
    parents = [np.where(p < 0, -1, p + b) for (_, p, _), b in zip(parts, begin, strict=True)]
    return np.concatenate([x for x, _, _ in parts]), np.concatenate(parents), np.concatenate([d for _, _, d in parts])


#: Of (parent, child) states, besides a bias: whether the child is a section of its own, and whether its names or tag tell.
EDGES = 2 + len(TAGS)


def edge_features(x: np.ndarray) -> np.ndarray:
    """Of each node, for the potential with its parent: bias, whether it has telling names, its tag."""
    named = x[:, len(TAGS) : len(TAGS) + len(WORDS)].any(axis=1)
    return np.concatenate([np.ones((len(x), 1), np.float32), named[:, None], x[:, : len(TAGS)]], axis=1).astype(np.float32)


@dataclass
class Model:
    """node: weights of the log odds of content; edge: weights of the 2 x 2 parent-child log potentials."""

    node: np.ndarray
    edge: np.ndarray  # (2, 2, EDGES)

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one or several trees: content marginals, and pair marginals (node, parent state, own state)."""
        n = len(x)
        phi = np.stack([np.zeros(n), x @ self.node], axis=1)
        psi = (edge_features(x) @ self.edge.reshape(4, EDGES).T).reshape(n, 2, 2)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))
        inner = phi.copy()  # own potential and children's messages
        up = np.zeros((n, 2))
        for own in reversed(levels[1:]):
            up[own] = np.logaddexp(*np.moveaxis(psi[own] + inner[own][:, None, :], 2, 0))
            np.add.at(inner, parent[own], up[own])
        down = np.zeros((n, 2))
        for own in levels[1:]:
            p = parent[own]
            rest = inner[p] + down[p] - up[own]
            down[own] = np.logaddexp(*np.moveaxis(psi[own] + rest[:, :, None], 1, 0))
        belief = inner + down
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        own = np.exp(belief[:, 1] - total)
        rest = (inner + down)[parent] - up
        pair = psi + rest[:, :, None] + inner[:, None, :]
        pair = np.exp(pair - total[:, None, None])
        pair[parent < 0] = 0
        return own, pair


def label_nodes(tree: Tree, wanted: list[str]) -> np.ndarray:
    """1 for nodes that hold wanted text, below the page's own frame; the pages' labels are texts of blocks.

    The body counts as one where wanted text stands in it or its own children, as on pages without a frame.
    """
    keep = set(wanted)
    y = np.zeros(len(tree.nodes), dtype=int)
    for own, text in tree.blocks:
        node = own
        while text in keep and node >= 0 and tree.nodes[node].tag not in ("", "html"):
            if tree.nodes[node].tag == "body" and node not in (own, tree.nodes[own].parent):
                break
            y[node] = 1
            node = tree.nodes[node].parent
    return y


def fit(pages: list[tuple[str, list[str]]], steps: int = 150, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Maximum likelihood of the labelled pages' states: gradient of true less expected features, by Adam."""
    parsed = [(parse(page), wanted) for page, wanted in pages]
    x, parent, depth = forest([tree for tree, _ in parsed])
    y = np.concatenate([label_nodes(tree, wanted) for tree, wanted in parsed])
    model = Model(np.zeros(SIZE), np.zeros((2, 2, EDGES)))
    m = [np.zeros_like(model.node), np.zeros_like(model.edge)]
    s = [np.zeros_like(model.node), np.zeros_like(model.edge)]
    child = np.flatnonzero(parent >= 0)
    true = np.zeros((len(x), 2, 2))
    true[child, y[parent[child]], y[child]] = 1
    edges = edge_features(x)
    for step in range(1, steps + 1):
        own, pair = model.marginals(x, parent, depth)
        g = [(y - own) @ x / len(x) - decay * model.node, ((true - pair).reshape(-1, 4).T @ edges).reshape(2, 2, EDGES) / len(x) - decay * model.edge]
        for i, w in enumerate((model.node, model.edge)):
            m[i] += 0.1 * (g[i] - m[i])
            s[i] += 0.001 * (g[i] ** 2 - s[i])
            w += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return model


def extract(model: Model, pages: list[str | None]) -> list[str]:
    """Main texts of pages; their trees pass messages together."""
    trees = [parse(p if BODY.search(p) else "<body>" + p) for p in (p or "" for p in pages)]
    own, _ = model.marginals(*forest(trees)) if trees else (np.zeros(0), None)
    out, begin = [], 0
    for tree in trees:
        out.append("\n\n".join(text for node, text in tree.blocks if own[begin + node] >= 0.5))
        begin += len(tree.nodes)
    return out


def extractor(model: Model, step: int = 64):
    """A mapInArrow function: (page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [t for at in range(0, batch.num_rows, step) for t in extract(model, batch.column(2).slice(at, step).to_pylist())]
            n = pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, labelled: list[tuple[str, list[str]]] = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return pages.select("page_id", "url", "html").mapInArrow(extractor(fit(labelled)), "page_id bigint, url string, text string, n_chars bigint")
