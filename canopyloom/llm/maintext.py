"""Main text of web pages by a tree-structured graphical model.

Each node of the page's tree, elements and runs of text alike, is content or not.
A node's potential is log-linear in its features; parent and child share a
potential for each pair of their states, one table for elements under elements and
one for text under elements. Sum-product messages pass from the leaves to the root
and back once, which gives every node's exact marginal. Runs of text with a
marginal of at least ``threshold`` are the main text, in page order.

Potentials are trained on labelled pages by the conditional likelihood's gradient:
observed features minus those expected under the marginals. ``python -m
canopyloom.llm.maintext`` trains them anew and writes main_text_model.json, which
``default_model`` reads.

A null or empty page, and one without content, has the empty text. Rows that
repeat or have a null id or url stay as they are. An empty table gives an empty
table. Columns other than id, url and html are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log1p
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyloom.llm import labelled_pages
from canopyloom.llm.domtree import Node, attributes, read

#: What names of classes, ids and roles tell, by group.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos promotion promoted banner dfp outbrain taboola",
    "nav": "nav navbar navigation menu menus topmenu breadcrumb breadcrumbs toc pagination pager tabs skip navi",
    "frame": "header masthead footer bottom colophon copyright legal top toolbar topbar site-header",
    "side": "sidebar side aside rail secondary related widget widgets recommended recommendations popular trending teaser teasers stories",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal newsletter subscribe subscription paywall disclaimer message overlay toast warning",
    "comment": "comment comments commentlist reply replies discussion responses disqus respond thread feedback reader",
    "share": "share shares sharing social tags tag meta byline author bio follow tools credits",
    "form": "form login search signup signin register contact",
    "content": "article content post entry main story body text page-content prose question answer maincontent",
}
NAMED = {w: group for group, ws in NAMES.items() for w in ws.split()}
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def group(word: str) -> str | None:
    """The group of a name, or of the longest name of four letters or more that it begins with."""
    return NAMED.get(word) or next((NAMED[word[:n]] for n in range(len(word) - 1, 3, -1) if word[:n] in NAMED), None)


def features(node: Node) -> list[str]:
    """What a node alone tells."""
    if node.tag:
        out = ["bias:element", "tag:" + (node.tag if node.tag not in HEADINGS else "h")]
        if node.tag == "h1":
            out.append("tag:h1")
        if node.attributes:
            own = attributes(node.attributes)
            words = {w.lower() for k in ("class", "id", "role", "aria-label") for w in _PART.findall(own.get(k, ""))}
            out += sorted({"name:" + g for g in map(group, words) if g}) or ["name:other"] * bool(words)
        return out
    n = len(node.text)
    out = ["bias:text", f"length:{min(6, int(log1p(n)))}"]
    if node.links:
        share = min(3, int(4 * node.links / n))
        out += [f"links:{share}", f"links:{share}:{min(5, int(log1p(n)))}"]
        if node.text[-1] in ".!?":
            out.append(f"links:{share}:ends")
    if node.text[-1] in ".!?\"'”»":
        out.append("ends")
    if "©" in node.text or "·" in node.text:
        out.append("sign:copyright")
    if ". " in node.text:
        out.append("sentences")
    return out


@lru_cache(1 << 14)
def _element_features(tag: str, source: str) -> tuple[str, ...]:
    return tuple(features(Node(tag, source, 0)))


def bulk(nodes: list[Node]) -> list[tuple[str, ...]]:
    """For each element how much text it holds and which share of it stands in links, for a text nothing."""
    chars, links, sentences = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.tag:
            chars[i], links[i], sentences[i] = len(node.text), node.links, ". " in node.text or node.text[-1] in ".!?"
        if i:
            for x in (chars, links, sentences):
                x[node.parent] += x[i]
    out: list[tuple[str, ...]] = []
    for node, c, k, e in zip(nodes, chars, links, sentences, strict=True):
        out.append((f"bulk:{min(4, int(log1p(c) / 1.6))}", f"linked:{min(3, int(4 * k / c))}", f"said:{min(3, e)}") if node.tag and c else ())
    return out


class Model:
    """unary: weight of a feature for the state content. pair: [kind][parent's state][child's state]."""

    def __init__(self):
        self.unary: dict[str, float] = defaultdict(float)
        self.pair = [[[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]

    def evidence(self, nodes: list[Node]) -> list[float]:
        get = self.unary.get
        return [sum(get(f, 0.0) for f in (*(_element_features(n.tag, n.attributes) if n.tag else features(n)), *b)) for n, b in zip(nodes, bulk(nodes), strict=True)]

    def marginals(self, nodes: list[Node], pairwise: bool = False):
        """P(content) of each node; with ``pairwise`` also P(parent's state, child's state) of each but the root."""
        own = self.evidence(nodes)
        size = len(nodes)
        tables = [[[exp(x) for x in row] for row in t] for t in self.pair]
        up = list(own)  # log odds of a node given what is below it
        message = [0.0] * size  # to the parent, as log odds
        for i in range(size - 1, 0, -1):
            node = nodes[i]
            t, o = tables[not node.tag], exp(max(-40.0, min(40.0, up[i])))
            message[i] = log((t[1][0] + t[1][1] * o) / (t[0][0] + t[0][1] * o))
            up[node.parent] += message[i]
        down = [0.0] * size  # log odds that the parent's side tells a node
        out = [0.0] * size
        pairs = [None] * size
        for i, node in enumerate(nodes):
            if i:
                # the parent's belief without this child's message
                t, o = tables[not node.tag], exp(max(-40.0, min(40.0, up[node.parent] + down[node.parent] - message[i])))
                down[i] = log((t[0][1] + t[1][1] * o) / (t[0][0] + t[1][0] * o))
                if pairwise:
                    c = exp(max(-40.0, min(40.0, up[i])))
                    joint = [[t[0][0], t[0][1] * c], [t[1][0] * o, t[1][1] * o * c]]
                    z = sum(map(sum, joint))
                    pairs[i] = [[x / z for x in row] for row in joint]
            out[i] = 1 / (1 + exp(-max(-40.0, min(40.0, up[i] + down[i]))))
        return (out, pairs) if pairwise else out


def label(nodes: list[Node]) -> list[int]:
    """A text's label is its mark; an element is content if most of its text is. Marks are taken off."""
    chars = [[0, 0] for _ in nodes]
    for node, c in zip(nodes, chars, strict=True):
        if not node.tag:
            marked = labelled_pages.MARK in node.text
            node.text = node.text.replace(labelled_pages.MARK, "")
            c[marked] += max(1, len(node.text))
    for i in range(len(nodes) - 1, 0, -1):
        for k in (0, 1):
            chars[nodes[i].parent][k] += chars[i][k]
    return [int(b > a) for a, b in chars]


def train(pages: list[str], rounds: int = 80, rate: float = 0.7, ridge: float = 0.0005) -> Model:
    """Adagrad on the conditional likelihood of the labelled pages."""
    data = []
    for html in pages:
        nodes = read(html)
        labels = label(nodes)
        data.append((nodes, labels, [[*features(n), *b] for n, b in zip(nodes, bulk(nodes), strict=True)]))
    model, seen = Model(), defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        gradient: dict = defaultdict(float)
        for nodes, labels, known in data:
            p, pairs = model.marginals(nodes, True)
            for i, node in enumerate(nodes):
                d = labels[i] - p[i]
                for f in known[i]:
                    gradient[f] += d
                if i:
                    kind = int(not node.tag)
                    for a in (0, 1):
                        for b in (0, 1):
                            gradient[kind, a, b] += (labels[node.parent] == a and labels[i] == b) - pairs[i][a][b]
        for key, g in gradient.items():
            now = model.unary[key] if isinstance(key, str) else model.pair[key[0]][key[1]][key[2]]
            g = g / len(data) - ridge * now
            seen[key] += g * g
            now += rate * g / seen[key] ** 0.5
            if isinstance(key, str):
                model.unary[key] = now
            else:
                model.pair[key[0]][key[1]][key[2]] = now
    model.unary = dict(model.unary)
    return model


FILE = Path(__file__).with_name("main_text_model.json")


@lru_cache(1)
def default_model() -> Model:
    """The trained potentials of the file; read on the driver, workers get them with their task."""
    told, model = json.loads(FILE.read_text()), Model()
    model.unary, model.pair = told["unary"], told["pair"]
    return model


def save(model: Model) -> None:
    FILE.write_text(json.dumps({"unary": {k: round(x, 6) for k, x in sorted(model.unary.items())}, "pair": [[[round(x, 6) for x in row] for row in t] for t in model.pair]}, indent=0) + "\n")


def main_text(html: str | None, model: Model, threshold: float = 0.5) -> str:
    nodes = read(html or "")
    p = model.marginals(nodes)
    return "\n".join(n.text for n, x in zip(nodes, p, strict=True) if not n.tag and x >= threshold)


def extract(pages: DataFrame, model: Model | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or default_model()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, model, threshold) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(task, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    save(train(labelled_pages.pages()))
