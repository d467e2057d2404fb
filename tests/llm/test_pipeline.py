"""The pipeline on small tables: brute force stage by stage, awkward rows, empty tables."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, awkward, brute_components, copies, library_ids

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark and documents with copies, leaks, secrets and texts without letters."""
    path = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(1)
    items = [" ".join(f"q{rnd.randint(0, 999)}" for _ in range(30)) for _ in range(5)]
    spark.createDataFrame([*enumerate(items), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, t, rnd.choice(["en", "de", None]), "s", len(t)) for i, t in copies()]
    for i in range(2000, 2040):
        words = [f"v{rnd.randint(0, 5000)}" for _ in range(80)]
        if i % 4 == 0:
            words[20:20] = items[i % 5].split()[5:25]
        if i % 5 == 0:
            words.insert(7, 'token = "' + "0123456789abcdef" * 3 + '"')
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(3000, "!!! 123", "en", "s", 7), (3001, None, None, None, None), (3002, "", "de", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path, rows, items


def test_pipeline_agrees_with_brute_force(spark, folder):
    path, rows, items = folder
    kept = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    root, _ = brute_components(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    stretches = {tuple(item.split()[k:k + 13]) for item in items for k in range(18)}
    kept = {i: t for i, t in kept.items() if not any(tuple(t.split()[k:k + 13]) in stretches for k in range(len(t.split())))}
    kept = {i: re.sub(r'token = "[0-9a-f]{48}', "[secret]", t) for i, t in kept.items()}
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, path).collect():
        pieces[p.doc_id].append((p.start, bytes(p.ids)))
    assert set(pieces) == set(kept)
    for i, own in pieces.items():
        assert b"".join(x for _, x in sorted(own)) == library_ids(kept[i], 1).tobytes()
    assert any("[secret]" in t for t in kept.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_survive_awkward_and_empty_tables(spark, folder, name):
    frame = spark.createDataFrame(awkward(), SCHEMA)
    clashing = frame.select("*", *[F.lit(1).alias(c) for c in ("lang_pred", "score", "_text", "kept", "component_id", "rep", "digest", "item_id", "spans", "ids", "_id", "row")])
    for docs in (frame, clashing, frame.limit(0)):
        out = STAGES[name](spark, docs, folder[0])
        n = out.count()
        if name == "pack_windows":
            assert n >= docs.count()
            continue
        assert out.columns == docs.columns and n <= docs.count()
        lost = set(r[0] for r in docs.select("doc_id").collect()) - set(r[0] for r in out.select("doc_id").collect())
        if name == "language":
            assert lost == {i for i, t, *_ in awkward() if i is not None and not any(map(str.isalpha, t or ""))} or not docs.take(1)
        if name in ("decontaminate", "remove_secrets"):
            assert not lost


def test_rows_with_equal_or_missing_ids_are_told_apart(spark, folder):
    long = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(7, long), (7, long), (None, long), (3, long + " x"), (7, other), (None, "c d"), (None, "c d"), (9, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    out = collections.Counter((r.doc_id, r.text) for r in STAGES["deduplicate"](spark, docs, folder[0]).collect())
    assert out == collections.Counter([(3, long + " x"), (7, other), (None, "c d"), (9, ""), (9, None), (None, None)])
