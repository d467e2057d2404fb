"""Main text of web pages by a graphical model on the tree of each page.

Every block element with text under it, and every run of text between block borders, is a node with two states: content or not. A node's own
potential is a weighted sum of its features; a table of four potentials ties it to its parent. Messages go up from the leaves and
down again (sum-product), which gives exact marginals on a tree; a run of text is kept where its marginal of content is above one half. Weights
maximise the likelihood of labelled pages: invented layouts (``layouts``), and a bounded sample of the table's own pages that
declare their article.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom, layouts
from .tables import fresh

TOGETHER = 1 << 20  # code points of pages that are worked on together; a longer page is worked on alone
SIGNS = ("cookie", "copyright", "©", "subscribe", "newsletter", "sign", "login", "reply", "comments", "share", "sponsored", "advertisement", "menu", "search", "privacy")
OUTSIDE = frozenset("nav aside footer form dialog".split())
OUTSIDE_NAMES = frozenset("ad ads advert advertisement comment comments sidebar related share nav menu footer newsletter notice cookie promo sponsored".split())
LANDMARKS = frozenset("article main nav aside footer header form dialog section".split())
EDGES = 3  # what hangs below an element: an element without names, one with names, a run of text


@dataclass(frozen=True)
class Learning:
    """``layouts`` invented pages, and at most ``sample`` pages of the table of at most ``characters`` code points each, in ``steps`` steps."""

    layouts: int = 800
    sample: int = 500
    characters: int = 20_000
    steps: int = 200
    seed: int = 0


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: np.ndarray  # of the features, for content
    ties: np.ndarray  # EDGES x state of the parent x state of the child


@dataclass
class Forest:
    """Trees of several pages. ``levels`` are the nodes by depth; parents stand in the level before."""

    parent: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """The columns ``keep``, then the main text and its code points, one row per input row. Row-local.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line break in page order. Scripts,
    styles, titles, controls and comments of the markup are never text. A null or empty page, and one without a content block, has an empty text.
    Repeated rows give repeated results; clashing names are the caller's to choose.
    """
    hidden = fresh("_html", keep)
    source = pages.select(*[pages[c].alias(c) for c in keep], pages[html_col].alias(hidden))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda b: _extract(b, model, list(keep), hidden, names), f"{schema}{', ' if keep else ''}`{names[0]}` string, `{names[1]}` long")


def fit(pages: DataFrame | None = None, learning: Learning = Learning(), html_col: str = "html") -> Model:
    """A model from invented layouts and, if ``pages`` is given, from the pages of a fixed sample of it that declare an article."""
    known = layouts.labelled(learning.layouts, learning.seed)
    if pages is not None and learning.sample:
        known += [(html, blocks) for html in sampled(pages, learning, html_col) if (blocks := declared(html))]
    return learn(known, learning.steps)


def sampled(pages: DataFrame, learning: Learning, html_col: str = "html") -> list[str]:
    """At most ``learning.sample`` different pages, the same at every run. A hash admits about twice as many as are wanted, wherever they lie, so
    little more than those reaches the driver; copies of a page have one hash and are one page."""
    source = pages.select(pages[html_col].alias("html")).filter(F.length("html").between(1, learning.characters)).withColumn("hash", F.xxhash64("html"))
    rows = pages.count()
    if rows > 2 * learning.sample:
        source = source.filter(F.pmod("hash", F.lit(1 << 40)) < int((1 << 40) * 2 * learning.sample / rows))
    return [r["html"] for r in source.groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").limit(learning.sample).collect()]


def declared(html: str) -> list[str]:
    """Blocks of a page's only ``article``, or only ``main``, but for parts that name themselves something else."""
    nodes = dom.parse(html).nodes
    for tag in ("article", "main"):
        roots = [i for i, n in enumerate(nodes) if n.tag == tag]
        if len(roots) == 1:
            inside = [False] * len(nodes)
            inside[roots[0]] = True
            for i, n in enumerate(nodes):
                if n.parent >= 0 and inside[n.parent]:
                    inside[i] = n.tag not in OUTSIDE and not OUTSIDE_NAMES & set(n.names)
            return [n.text for i, n in enumerate(nodes) if inside[i] and not n.tag]
    return []


# ---- features ----------------------------------------------------------------------------------------------------------

def described(page: dom.Page) -> tuple[list[int], list[list[str]]]:
    """Nodes with text (their number in the page), and the features of each."""
    nodes = page.nodes
    size, linked, runs = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    mark, named = [""] * len(nodes), [()] * len(nodes)  # of the nearest element that has one: its landmark, its names
    for i, n in enumerate(nodes[1:], 1):
        mark[i] = n.tag if n.tag in LANDMARKS else mark[n.parent]
        named[i] = n.names or named[n.parent]
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            size[i], linked[i], runs[i] = len(n.text), n.linked, 1
        if i:
            size[n.parent] += size[i]
            linked[n.parent] += linked[i]
            runs[n.parent] += runs[i]
    kept = [i for i in range(len(nodes)) if runs[i]]
    texts = [i for i in kept if not nodes[i].tag]
    place = {i: k for k, i in enumerate(texts)}
    out = []
    for i in kept:
        n = nodes[i]
        density = "0" if not linked[i] else str(1 + min(3, 4 * linked[i] // (size[i] + 1)))
        length = str(min(size[i].bit_length(), 9))  # labelled pages hold few longer runs
        if n.tag:
            own = ["e", f"e:{n.tag}", f"e:link{density}", f"e:len{min(int(length), 7)}", f"e:mean{min((size[i] // runs[i]).bit_length(), 8)}",
                   f"e:{n.tag}>link{density}"]
            own += [f"n:{name}" for name in n.names]
            own += ["e:named"] if n.names else [f"e:{n.tag}:plain"]
            own += [f"e:under:{mark[n.parent]}", f"e:{mark[n.parent]}>{n.tag}"]
        else:
            t, k = n.text, place[i]
            low = t.lower()
            own = ["t", f"t:in:{nodes[n.parent].tag}", f"t:link{density}", f"t:len{length}", f"t:at{4 * k // len(texts)}", f"t:end{t[-1] if t[-1] in '.!?。:…' else '-'}",
                   f"t:len{length}:link{density}"]
            own += [f"t:under:{mark[i]}", f"t:{mark[i]}>{nodes[n.parent].tag}", *(f"t:name:{name}" for name in named[i])]
            own += [f"t:has:{s}" for s in SIGNS if s in low] if len(t) < 300 else []
            own += [f"t:before{min(size[texts[k - 1]].bit_length(), 9)}"] if k else []
            own += [f"t:after{min(size[texts[k + 1]].bit_length(), 9)}"] if k + 1 < len(texts) else []
        out.append(own)
    return kept, out


def forest(pages: list[dom.Page], kept: list[list[int]]) -> Forest:
    parent, edge, depth = [], [], []
    for page, own in zip(pages, kept, strict=True):
        base = len(parent)
        at = {i: base + k for k, i in enumerate(own)}
        for i in own:
            n = page.nodes[i]
            parent.append(at.get(n.parent, -1))
            edge.append(2 if not n.tag else 1 if n.names or n.tag in OUTSIDE else 0)
            depth.append(n.depth)
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    return Forest(np.array(parent, np.int64), np.array(edge, np.int64), np.split(order, np.cumsum(np.bincount(deep))[:-1]) if len(deep) else [])


# ---- inference -----------------------------------------------------------------------------------------------------------

def marginals(trees: Forest, unary: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the two states of each node, sums of edge marginals shaped as ``ties``, and the sum of the log partition functions."""
    up = unary.copy()
    sent = np.zeros_like(up)  # what each node tells its parent
    for own in reversed(trees.levels[1:]):
        to = trees.parent[own]
        sent[own] = _log_sum(up[own][:, None, :] + ties[trees.edge[own]], 2)
        for state in range(2):
            up[:, state] += np.bincount(to, sent[own, state], len(up))
    belief = up.copy()
    edges = np.zeros_like(ties)
    total = float(_log_sum(up[trees.levels[0]], 1).sum()) if trees.levels else 0.0
    for own in trees.levels[1:]:
        rest = belief[trees.parent[own]] - sent[own]  # the parent without this child
        joint = rest[:, :, None] + ties[trees.edge[own]] + up[own][:, None, :]
        belief[own] = up[own] + _log_sum(rest[:, :, None] + ties[trees.edge[own]], 1)
        joint = np.exp(joint - _log_sum(joint.reshape(-1, 4), 1)[:, None, None])
        for e in range(EDGES):
            edges[e] += joint[trees.edge[own] == e].sum(0)
    return np.exp(belief - _log_sum(belief, 1)[:, None]), edges, total


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    if x.shape[axis] == 2:
        return np.logaddexp(x.take(0, axis), x.take(1, axis))
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def learn(known: list[tuple[str, list[str]]], steps: int = 200, prior: float = 4e-6, rate: float = 0.25) -> Model:
    """Maximum likelihood by gradient ascent with adaptive steps."""
    pages = [dom.parse(html) for html, _ in known]
    parts = [described(page) for page in pages]
    features: dict[str, int] = {}
    rows, columns, states = [], [], []
    for page, (kept, own), (_, blocks) in zip(pages, parts, known, strict=True):
        content = _states(page, blocks)
        for i, names in zip(kept, own, strict=True):
            rows += [len(states)] * len(names)
            columns += [features.setdefault(name, len(features)) for name in names]
            states.append(content[i])
    trees = forest(pages, [kept for kept, _ in parts])
    row, column, state = np.array(rows, np.int64), np.array(columns, np.int64), np.array(states, np.int64)
    if not len(state):
        return Model({}, np.zeros(0), np.zeros((EDGES, 2, 2)))
    below = trees.parent >= 0
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (trees.edge[below], state[trees.parent[below]], state[below]), 1)
    weights, ties = np.zeros(len(features)), np.zeros((EDGES, 2, 2))
    first, second = [np.zeros_like(weights), np.zeros_like(ties)], [np.zeros_like(weights), np.zeros_like(ties)]
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(len(state)), np.bincount(row, weights[column], len(state))], 1)
        chance, edges, _ = marginals(trees, unary, ties)
        slopes = [np.bincount(column, (state - chance[:, 1])[row], len(features)) / len(state) - prior * weights, (seen - edges) / len(state) - prior * ties]
        for k, (value, slope) in enumerate(zip((weights, ties), slopes, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope ** 2
            value += rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 2 * (1 - step / (steps + 1)))
    return Model(features, weights, ties)


def _states(page: dom.Page, blocks: list[str]) -> list[int]:
    """A run of text is content if the labels list it (each listed text counts once). An element is, if it is or lies under the smallest
    element that holds all content, and at least half of its text is content."""
    left: dict[str, int] = {}
    for text in blocks:
        left[" ".join(text.split())] = left.get(" ".join(text.split()), 0) + 1
    nodes = page.nodes
    size, good = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if not n.tag:
            size[i] = len(n.text)
            good[i] = size[i] * (left.get(n.text, 0) > 0)
            left[n.text] = left.get(n.text, 0) - 1
        if i:
            size[n.parent] += size[i]
            good[n.parent] += good[i]
    whole = max((i for i in range(len(nodes)) if good[i] == good[0]), default=0)
    inside = [False] * len(nodes)
    inside[whole] = good[0] > 0
    for i in range(1, len(nodes)):
        inside[i] |= inside[nodes[i].parent]
    return [int(inside[i] and 2 * good[i] >= size[i] > 0) for i in range(len(nodes))]


def main_texts(html: list[str], model: Model) -> list[str]:
    pages = [dom.parse(h) for h in html]
    parts = [described(page) for page in pages]
    known, row, column, base = model.features, [], [], 0
    for kept, own in parts:
        for k, names in enumerate(own):
            found = [known[name] for name in names if name in known]
            row += [base + k] * len(found)
            column += found
        base += len(kept)
    unary = np.zeros((base, 2))
    unary[:, 1] = np.bincount(np.array(row, np.int64), model.weights[np.array(column, np.int64)], base) if base else 0
    chance, _, _ = marginals(forest(pages, [kept for kept, _ in parts]), unary, model.ties)
    texts, base = [], 0
    for page, (kept, _) in zip(pages, parts, strict=True):
        good = chance[base:base + len(kept), 1] > 0.5
        texts.append("\n".join(page.nodes[i].text for i, g in zip(kept, good, strict=True) if g and not page.nodes[i].tag))
        base += len(kept)
    return texts


def _extract(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str], html_col: str, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(html_col)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            before = int(sizes[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
            part = batch.slice(low, high - low)
            texts = pa.array(main_texts([h or "" for h in part.column(html_col).to_pylist()], model), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts, pc.utf8_length(texts).cast(pa.int64())], [*keep, *names])
            low = high
