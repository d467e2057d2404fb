"""Blocked search against scoring every document for every query."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id long, text string, score int, rank string, query string", "item_id long, text string, n int"


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, best=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = collections.Counter(t for _, c in bags for t in c)
    out = collections.Counter()
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for i, c in bags:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for k, (score, _, _, i) in enumerate(sorted(scored)[:best]):
            out[(item, k + 1, i, -score)] += 1
    return out


def corpus(seed, rows):
    rnd = random.Random(seed)
    common = ["the", "of", "And", "é", "你好", "x1"]
    rare = [f"w{k}" for k in range(300)]
    topics = [rnd.sample(rare, 25) for _ in range(8)]
    texts = [" ".join(rnd.choice(common if rnd.random() < .5 else rnd.choice(topics) if rnd.random() < .2 else topics[i % 8]) + rnd.choice(["", ".", ",", "-"])
                      for _ in range(rnd.randint(1, 60))) for i in range(rows)]
    texts += [texts[3]] * 25 + [None, "", "...", "\x00", "THE", "the " * 5000, "solo"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[3]), (None, texts[5])]
    items = [(k, " ".join(rnd.choice([*common, *rnd.choice(topics)]) for _ in range(rnd.randint(1, 30)))) for k in range(12)]
    items += [(50, texts[3]), (51, None), (52, "?!"), (53, "unseen"), (0, "the of"), (0, "the of"), (None, "w1 w2 w3"), (54, "SOLO solo"), (55, "the")]
    return docs, items


@pytest.mark.parametrize("how", [s.Search(), s.Search(block=5, documents=90, queries=4), s.Search(block=3, cells=1, terms=20), s.Search(best=3, block=9, documents=300)])
def test_search_agrees_with_brute_force(spark, how):
    docs, items = corpus(1, 700)
    frame = spark.createDataFrame([(i, t, 1, "r", "q") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS).repartition(2)
    found = collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in s.search(frame, asked, how).collect())
    assert found == brute(docs, items, how.best)


def test_empty_tables_and_other_ids(spark):
    docs, items = corpus(2, 20)
    frame = spark.createDataFrame([(i, t, 1, "r", "q") for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    assert s.search(frame.limit(0), asked).count() == 0
    assert s.search(frame, asked.limit(0)).count() == 0
    named = s.search(frame.withColumn("doc_id", F.concat(F.lit("d"), F.lpad("doc_id", 4, "0"))), asked.filter("item_id = 50"))
    want = sorted((k, None if i is None else f"d{i:04}", v) for (item, k, i, v), _ in brute(docs, [(50, items[12][1])]).items())
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in named.collect()) == want


def shard(rows, columns, block=6, seed=0):
    rng = np.random.default_rng(seed)
    full = np.where(rng.random((rows, columns)) < .3, rng.integers(1, 10 ** 6, (rows, columns)), 0)
    full[:, 0] = rng.integers(1, 50, rows)
    owner, place = np.nonzero(full)
    offsets = np.searchsorted(owner, np.arange(rows + 1))
    weights = rng.integers(1, 30000, columns)
    return s.Shard(list(range(rows)), offsets, place.astype(np.int32), full[owner, place], weights, block), full, weights


def test_summaries_are_largest_coordinates_and_bounds_hold():
    made, full, weights = shard(80, 30)
    for t in range(30):
        listed = np.concatenate([*made.members[made.first[t]:made.first[t + 1]], []]) if len(made.lists[t]) > s.DIRECT else made.lists[t]
        assert sorted(listed) == sorted(np.flatnonzero(full[:, t]))  # blocks divide the list
    columns = np.array([1, 4, 7, 29])
    bound = made.bounds(columns, weights[columns], np.arange(len(made.members)))
    for b, own in enumerate(made.members):
        top = full[own].max(0)
        assert (made.summary[:, b] == -(-top // s.UNIT)).all()
        assert bound[b] >= (full[own][:, columns] @ weights[columns]).max()


def test_blocks_are_skipped_and_only_by_their_bounds():
    rng = np.random.default_rng(5)
    groups, size = 20, 60  # documents of a group share their own terms, and one term is in all
    full = np.zeros((groups * size, groups * 4 + 1), np.int64)
    full[:, -1] = rng.integers(1000, 2000, len(full))
    for g in range(groups):
        full[g * size:(g + 1) * size, g * 4:g * 4 + 4] = rng.integers(300000, 500000, (size, 4))
    owner, place = np.nonzero(full)
    weights = np.full(full.shape[1], 3000)
    made = s.Shard(list(range(len(full))), np.searchsorted(owner, np.arange(len(full) + 1)), place.astype(np.int32), full[owner, place], weights, 48)
    best = s.Best(10)
    places = np.array([20, 21, 22, 23, 80])
    scored = made.answer(places, weights[places], best)
    want = sorted((-int(v), i) for i, v in enumerate(full[:, places] @ weights[places]))[:10]
    assert [(a, c) for a, _, c in best.found] == want
    assert scored <= 4 * size


def test_impacts_of_huge_corpora():
    tf, n = np.array([1, 7, 10 ** 6]), np.array([1, 10 ** 9, 10 ** 6])
    for documents, total in ((10, 10 ** 9 + 10 ** 6 + 1), (10 ** 11, 10 ** 14)):
        want = [10 ** 9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(k) * documents // total)) for t, k in zip(tf, n, strict=True)]
        assert s.impacts(tf, n, documents, total).tolist() == want
