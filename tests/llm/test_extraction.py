"""Page trees, exact inference on them, and what the fitted model keeps of pages it has not seen."""

from __future__ import annotations

import itertools
import math
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import dom, extraction, layouts


@pytest.fixture(scope="module")
def model():
    return extraction.fit(learning=extraction.Learning(layouts=500, steps=150))


def runs(html):
    return [n.text for n in dom.parse(html).nodes if not n.tag]


@pytest.mark.parametrize("html, want", [
    ("", []), (" \n ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<p>b<div>c<br>d</div>e", ["a", "b", "c d", "e"]),
    ("<ul><li>a<li>b <i>c</i></ul>d", ["a", "b c", "d"]),
    ("x<!-- <p>no --><b>y</b>z", ["xyz"]),
    ("<script>var t='</p>';</script><style>p{}</style><title>t</title>a", ["a"]),
    ("<SCRIPT>no</script >a<textarea>no</textarea>b", ["ab"]),
    ("a<script>never ends <p>x", ["a"]),
    ("a <textarea> never ends <p>x", ["a never ends", "x"]),
    ("<p title='a > b'>q</p>", ["q"]), ('<p title="never ends>q</p>', ["q"]), ("a < b <3 c", ["a < b <3 c"]),
    ("&eacute;&#233;&#xE9;&nbsp;x &lt;p&gt; &am", ["ééé x <p> &am"]),
    ("<select><option>no</select><button>no</button>yes", ["yes"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>a</div></section>b</p>", ["a", "b"]),
    ("<h2>a<h3>b</h2>c", ["a", "b", "c"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("a<hr>b", ["a", "b"]),
    ("<div" + " " * 5, []), ("</", ["</"]), ("<?php x ?>a<!doctype html>b", ["ab"]),
])
def test_runs_of_text(html, want):
    assert runs(html) == want


def test_long_odd_markup_is_linear():
    for html in ("<div>" * 100_000 + "x", '<a b="' * 100_000, "<textarea>" * 100_000, "</p>" * 100_000, "<p>" * 100_000 + "y", "<" * 300_000, "<!--" * 100_000, "<li>a" * 50_000):
        page = dom.parse(html)
        assert max(n.depth for n in page.nodes) <= dom.DEEPEST + 1
    deep = dom.parse("".join(f"<div>{k}" for k in range(2000)))
    assert [n.text for n in deep.nodes if not n.tag] == [str(k) for k in range(2000)]


def test_links_and_names():
    nodes = dom.parse('<div class="siteHeader top-2" id=x hidden>ab <a href="/q">cd</a></div><nav role=\'menu\'>e</nav>').nodes
    assert [(n.tag, n.names, n.text, n.linked) for n in nodes[1:]] == [
        ("div", ("site", "header", "top", "x", "hidden"), "", 0), ("", (), "ab cd", 2), ("nav", ("menu",), "", 0), ("", (), "e", 0)]


def random_forest(rng, n):
    parent = [-1 if k == 0 or rng.random() < .1 else int(rng.integers(0, k)) for k in range(n)]
    depth = []
    for p in parent:
        depth.append(0 if p < 0 else depth[p] + 1)
    order = np.argsort(depth, kind="stable")
    return extraction.Forest(np.array(parent), rng.integers(0, extraction.EDGES, n), np.split(order, np.cumsum(np.bincount(depth))[:-1]))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_marginals_agree_with_all_labellings(n):
    rng = np.random.default_rng(n)
    for _ in range(8):
        trees, unary, ties = random_forest(rng, n), rng.normal(size=(n, 2)) * 2, rng.normal(size=(extraction.EDGES, 2, 2)) * 2
        total, nodes, edges = 0.0, np.zeros((n, 2)), np.zeros_like(ties)
        for states in itertools.product((0, 1), repeat=n):
            below = [k for k in range(n) if trees.parent[k] >= 0]
            weight = math.exp(sum(unary[k, s] for k, s in enumerate(states)) + sum(ties[trees.edge[k], states[trees.parent[k]], states[k]] for k in below))
            total += weight
            for k, s in enumerate(states):
                nodes[k, s] += weight
            for k in below:
                edges[trees.edge[k], states[trees.parent[k]], states[k]] += weight
        found, joint, log = extraction.marginals(trees, unary, ties)
        assert found == pytest.approx(nodes / total) and joint == pytest.approx(edges / total)
        roots = int((trees.parent < 0).sum())
        assert log == pytest.approx(math.log(total)) and roots >= 1


def test_likelihood_rises_while_learning():
    known = layouts.labelled(40, 3)
    pages = [dom.parse(h) for h, _ in known]
    parts = [extraction.described(p) for p in pages]
    trees = extraction.forest(pages, [k for k, _ in parts])
    states = np.array([s[i] for p, (kept, _), (_, b) in zip(pages, parts, known, strict=True) for s in [extraction._states(p, b)] for i in kept])

    def likelihood(model):
        unary = np.zeros((len(states), 2))
        names = [x for _, own in parts for x in own]
        unary[:, 1] = [sum(model.weights[model.features[f]] for f in own) for own in names]
        _, _, total = extraction.marginals(trees, unary, model.ties)
        below = trees.parent >= 0
        return unary[np.arange(len(states)), states].sum() + model.ties[trees.edge[below], states[trees.parent[below]], states[below]].sum() - total

    steps = [likelihood(extraction.learn(known, k)) for k in (1, 10, 60)]
    assert steps[0] < steps[1] < steps[2] < 0


def test_layouts_it_has_not_seen(model):
    known = layouts.labelled(150, 99)
    found = extraction.main_texts([h for h, _ in known], model)
    good = sum(f == "\n".join(" ".join(b.split()) for b in blocks) for f, (_, blocks) in zip(found, known, strict=True))
    assert good >= 0.88 * len(known)


class Article(HTMLParser):
    """The plain path for one layout: whatever stands in ``article``."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_of_the_table_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = extraction.extract(pages, extraction.fit(pages, extraction.Learning(layouts=300, sample=100)), keep=("page_id", "html"))
    wrong = 0
    for r in found.collect():
        reader = Article()
        reader.feed(r["html"])
        want = "\n".join(b for b in (" ".join(b.split()) for b in reader.blocks) if b)
        wrong += r["text"] != want
        assert r["n_chars"] == len(r["text"])
    assert wrong <= 1


def test_odd_tables(spark, model):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<article><h1>A title here</h1><p>" + "Long words here, and more of them. " * 40_000 + "</p></article>"), (3, "x", "<p>\x00</p><<<>>>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("_html", F.lit("h"))
    found = extraction.extract(frame, model, keep=("page_id", "url", "_html")).collect()
    assert len(found) == len(rows) and all(r["_html"] == "h" for r in found)
    assert [r["text"] for r in found if r["page_id"] == 1] == ["", ""]
    assert next(r for r in found if r["page_id"] is None)["n_chars"] > 1_000_000
    assert extraction.extract(frame.limit(0), model).count() == 0
    assert extraction.fit(frame.limit(0), extraction.Learning(layouts=0)).weights.size == 0
