"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with runs of text as leaves. Each node is a binary
variable, content or not. Its own features (kind of element, words in class, id and role,
length, links, sentences) give it a potential, each edge to its parent another one by the
kind of the child. Messages go up to the root and down again; their sums and products are
exact on a tree and give each node's marginal. Runs with a marginal of at least a half are
the text. The weights are fitted to labelled pages (``labelled.py``) by exact gradients of the
likelihood, on the driver, and are a few hundred numbers.

Defined results: a null or empty html, and a page without content, give an empty text.
References are decoded, white space in a run becomes one space, runs are joined by a line
feed in page order. Unclosed and misplaced tags are read as browsers do in the main cases:
a block closes an open paragraph, an item closes an item, an unmatched end tag is nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML.
RAW = frozenset("script style textarea noscript template iframe svg math object title canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "html head body article main section div p nav header footer aside form fieldset ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address details summary dialog button label legend menu "
    "center hgroup search".split()) | HEADINGS
CLOSES_PARAGRAPH = BLOCKS - frozenset("html head body td th tr thead tbody tfoot caption button label legend".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}

# Words in class, id and role that tell what an element is for.
AWAY = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside rail ad ads advert advertisement adsense banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations trending breadcrumb breadcrumbs pagination "
    "pager widget search login toolbar tags copyright legal skip contentinfo complementary dialog alertdialog".split())
TALK = frozenset("comment comments commentlist reply replies respond disqus discussion reader".split())
KEEP = frozenset("article content main post entry story body text maincontent articlebody prose".split())

KINDS = ["article", "main", "section", "div", "p", "heading", "nav", "header", "footer", "aside", "form", "list", "item",
         "table", "cell", "quote", "pre", "figure", "control", "root", "run", "other"]
_KIND = {**{h: "heading" for h in HEADINGS}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item",
         "dd": "item", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell",
         "caption": "cell", "blockquote": "quote", "figcaption": "figure", "fieldset": "form", "button": "control", "label": "control",
         "legend": "control", "html": "root", "body": "root", "search": "form", "dialog": "aside"}
_KIND_AT = {tag: KINDS.index(_KIND.get(tag, tag if tag in KINDS else "other")) for tag in BLOCKS}
RUN = KINDS.index("run")
FEATURES = len(KINDS) + 12
EDGES = 5  # kinds of edges, by the child: away, talk, keep, run, other

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|data-content)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ENDS = re.compile(r"[.!?;:](?:\s|$)")


@dataclass
class Tree:
    parent: list[int]
    kind: list[int]
    marks: list[int]  # bits: 1 away, 2 talk, 4 keep, 8 hidden
    texts: list[str]  # of runs, in page order
    runs: list[int]  # their nodes
    linked: list[int]  # characters inside links, by run
    labels: list[int | None]  # of runs, where the page is labelled


def marks_of(attributes: str) -> tuple[int, int | None]:
    found, label = 0, None
    for name, *value in _NAMES.findall(attributes):
        value = value[0] or value[1] or value[2]
        if name.lower() == "data-content":
            label = int(value)
            continue
        for word in _PARTS.findall(_CAMEL.sub(" ", value).lower()):
            found |= (word in AWAY) | (word in TALK) << 1 | (word in KEEP) << 2
    if "hid" in attributes or "display" in attributes.lower():
        found |= bool(_HIDDEN.search(attributes)) << 3
    return found, label


def read(page: str) -> Tree:
    """The tree of a page; node 0 is the root."""
    tree = Tree([0], [KINDS.index("root")], [0], [], [], [], [])
    stack, labels = [("", 0, None)], None
    pieces: list[str] = []
    linked = links = 0

    def close_run():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            tree.parent.append(stack[-1][1])
            tree.kind.append(RUN)
            tree.marks.append(0)
            tree.runs.append(len(tree.parent) - 1)
            tree.texts.append(text)
            tree.linked.append(linked)
            tree.labels.append(stack[-1][2])
        linked = 0

    def pop_to(depth: int):
        close_run()
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            plain = html.unescape(text) if "&" in text else text
            pieces.append(plain)
            if links:
                linked += len(plain.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
        elif name == "hr":
            close_run()
        elif name not in BLOCKS:
            continue
        elif closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
        else:
            if name in CLOSES_PARAGRAPH and stack[-1][0] in ("p", *HEADINGS) and (stack[-1][0] == "p" or name in HEADINGS):
                pop_to(len(stack) - 1)
            elif name in CLOSES:
                same, bound = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in bound:
                        break
                    if stack[depth][0] in same:
                        pop_to(depth)
                        break
            close_run()
            marks, label = marks_of(m[3] or m[6] or "") if m[3] or m[6] else (0, None)
            tree.parent.append(stack[-1][1])
            tree.kind.append(_KIND_AT[name])
            tree.marks.append(marks)
            stack.append((name, len(tree.parent) - 1, stack[-1][2] if label is None else label))
    close_run()
    return tree


class Forest:
    """Trees side by side: parents, depths, features and edge kinds as arrays."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees])
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.parent = np.concatenate([np.array(t.parent) for t in trees]) + base
        self.kind = np.concatenate([np.array(t.kind) for t in trees])
        marks = np.concatenate([np.array(t.marks) for t in trees])
        self.root = self.parent == np.arange(len(self.parent))
        run_at = np.cumsum(sizes) - sizes
        self.runs = np.concatenate([np.array(t.runs, int) + b for t, b in zip(trees, run_at)])
        n = len(self.parent)
        depth, up = np.zeros(n, int), np.where(self.root, -1, self.parent)
        live = np.flatnonzero(up >= 0)
        while len(live):
            depth[live] += 1
            up[live] = np.where(self.root[up[live]], -1, self.parent[up[live]])
            live = live[up[live] >= 0]
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2 if n else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]  # from depth 1 down
        texts = [x for t in trees for x in t.texts]
        length = np.array([len(x) for x in texts], float)
        linked = np.minimum(np.array([x for t in trees for x in t.linked], float) / np.maximum(length, 1), 1)
        ends = np.array([len(_ENDS.findall(x)) for x in texts], float)
        f = np.zeros((n, FEATURES))
        f[np.arange(n), self.kind] = 1
        k = len(KINDS)
        for bit in range(4):
            f[:, k + bit] = marks >> bit & 1
        above = self.kind[self.parent]
        f[self.runs, k + 4] = np.log1p(length) / 6
        f[self.runs, k + 5] = linked
        f[self.runs, k + 6] = np.minimum(ends, 4) / 4
        f[self.runs, k + 7] = length < 25
        f[self.runs, k + 8] = np.isin(above[self.runs], [KINDS.index(x) for x in ("p", "quote", "pre")])
        f[self.runs, k + 9] = above[self.runs] == KINDS.index("heading")
        f[self.runs, k + 10] = np.isin(above[self.runs], [KINDS.index(x) for x in ("item", "control", "nav", "footer", "form")])
        f[:, k + 11] = 1
        self.features = f
        away = (marks & 9 > 0) | np.isin(self.kind, [KINDS.index(x) for x in ("nav", "footer", "aside", "form", "control")])
        keep = (marks & 4 > 0) | np.isin(self.kind, [KINDS.index(x) for x in ("article", "main")])
        self.edge = np.select([marks & 2 > 0, away, keep, self.kind == RUN], [1, 0, 2, 3], 4)

    def beliefs(self, unary: np.ndarray, pair: np.ndarray):
        """Log odds of each node, and of the message each child sends and gets.

        pair[k] holds the log potentials of (parent 0, child 1) and (parent 1, child 0).
        """
        n = len(unary)
        up, down, held = np.zeros(n), np.zeros(n), unary.copy()
        p01, p10 = pair[self.edge, 0], pair[self.edge, 1]
        for nodes in reversed(self.levels):
            x = held[nodes]
            up[nodes] = np.logaddexp(x, p10[nodes]) - np.logaddexp(x + p01[nodes], 0)
            held += np.bincount(self.parent[nodes], up[nodes], minlength=n)
        for nodes in self.levels:
            x = held[self.parent[nodes]] - up[nodes]
            down[nodes] = np.logaddexp(x, p01[nodes]) - np.logaddexp(x + p10[nodes], 0)
            held[nodes] += down[nodes]
        return held, up, down


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, forest: Forest) -> np.ndarray:
        held, _, _ = forest.beliefs(forest.features @ self.weights, self.pair)
        return 1 / (1 + np.exp(-np.clip(held, -500, 500)))


def targets(forest: Forest, trees: list[Tree]) -> np.ndarray:
    """Labels of all nodes: runs as given; an element is content if most of its text is."""
    n = len(forest.parent)
    label = np.array([x or 0 for t in trees for x in t.labels])
    size = np.array([len(x) for t in trees for x in t.texts], float)
    good, all_ = np.zeros(n), np.zeros(n)
    good[forest.runs], all_[forest.runs] = size * label, size
    for nodes in reversed(forest.levels):
        good += np.bincount(forest.parent[nodes], good[nodes], minlength=n)
        all_ += np.bincount(forest.parent[nodes], all_[nodes], minlength=n)
    found = (good * 2 > all_).astype(float)
    found[forest.runs] = label
    return found


def fit(pages: list[str], rounds: int = 250, rate: float = 0.1, ridge: float = 0.02) -> Model:
    """Maximum likelihood by gradient ascent with momentum and step sizes of each weight."""
    trees = [read(p) for p in pages]
    forest = Forest(trees)
    y = targets(forest, trees)
    child = np.flatnonzero(~forest.root)
    above, kind = forest.parent[child], forest.edge[child]
    model = Model(np.zeros(FEATURES), np.full((EDGES, 2), -0.5))
    count = len(pages)
    empirical = np.stack([np.bincount(kind, (y[above] == a) & (y[child] == b), minlength=EDGES) for a, b in ((0, 1), (1, 0))], 1)
    first, second = np.zeros(FEATURES + 2 * EDGES), np.zeros(FEATURES + 2 * EDGES)
    for step in range(1, rounds + 1):
        held, up, down = forest.beliefs(forest.features @ model.weights, model.pair)
        p = 1 / (1 + np.exp(-held))
        # Of each edge, the parent without this child and the child without its parent.
        x, z = held[above] - up[child], held[child] - down[child]
        logs = np.stack([np.zeros(len(child)), z + model.pair[kind, 0], x + model.pair[kind, 1], x + z])
        logs -= np.logaddexp.reduce(logs, axis=0)
        expected = np.stack([np.bincount(kind, np.exp(logs[i]), minlength=EDGES) for i in (1, 2)], 1)
        gradient = np.concatenate([forest.features.T @ (y - p), (empirical - expected).ravel()]) / count
        gradient -= ridge * np.concatenate([model.weights, model.pair.ravel()])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        move = rate * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        model.weights += move[:FEATURES]
        model.pair += move[FEATURES:].reshape(EDGES, 2)
    return model


def extract(model: Model, pages: list[str | None]) -> list[str]:
    trees = [read(p or "") for p in pages]
    forest = Forest(trees)
    chosen = model.marginals(forest)[forest.runs] >= 0.5
    found, at = [], 0
    for t in trees:
        keep = chosen[at:at + len(t.texts)]
        found.append("\n".join(x for x, k in zip(t.texts, keep) if k))
        at += len(t.texts)
    return found


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract(shared.value, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
