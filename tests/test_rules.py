"""Rules as rows, confined paths, edit distances and the table function on odd input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import kernels, sql
from lectern.operators import chapters, clips, order, rules, select
from lectern.operators import quality as ql

RULES = "scope string, ordinal int, pattern string"


def test_broken_rules_are_found_row_by_row(spark):
    table = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "("), ("b", 1, None), ("b", 2, "[z")], RULES)
    assert {r["pattern"] for r in rules.broken_rules(table).collect()} == {"(", None, "[z"}
    with pytest.raises(ValueError, match="regular expression"):
        rules.check_rules(table)
    rules.check_rules(table.filter("pattern = 'ok'"))
    with pytest.raises(ValueError, match="Invalid regular expression"):
        chapters.exclude_chapters(spark.createDataFrame([("x",)], "title string"), ["ok", "("])


def test_first_rule_by_ordinal_and_no_rules(spark):
    table = spark.createDataFrame([("a", 2, "x"), ("a", 1, "xy"), ("b", 1, "é\\w")], RULES)
    docs = spark.createDataFrame([("a", "x\nxy\nz"), ("b", "x\néà\n"), ("c", "x"), (None, "x"), ("a", None), ("a", "")], "lang string, text string")
    found = [(r["lang"], r["text"], [e["n"] for e in r["audit"]]) for r in rules.drop_matching_lines(docs, table, "lang").collect()]
    assert sorted(found, key=repr) == sorted([("a", "z", [2]), ("b", "x", [1]), ("c", "x", []), (None, "x", []), ("a", None, []), ("a", "", [])], key=repr)
    titles = rules.exclude_chapters(docs.withColumnRenamed("text", "title"), table, "lang").collect()
    assert [r["excluded_by"] for r in titles if r["title"] == "x\nxy\nz"] == ["xy"]


def test_plan_does_not_grow_with_the_rules(spark):
    docs = spark.createDataFrame([("a", "x")], "lang string, text string")
    def size(n):
        table = spark.createDataFrame([("a", i, f"p{i}") for i in range(n)], RULES)
        return len(rules.drop_matching_lines(docs, table, "lang")._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(1) == size(400)
    many = spark.createDataFrame([("a", i, f"p{i}") for i in range(rules.MOST + 1)], RULES)
    with pytest.raises(Exception, match="more than"):
        rules.drop_matching_lines(docs, many, "lang").collect()


@pytest.mark.parametrize("path, folder, want", [
    ("a/b.mp3", "/o/1", "a/b.mp3"), ("./a//b", "/o/1", "a/b"), ("a/../b", "/o/1", "b"), ("../b", "/o/1", None), ("a/../../b", "/o/1", None), ("/o/1/b", "/o/1", "b"), ("/o/1/b", "/o/1/", "b"),
    ("/o/12/b", "/o/1", None), ("/o/1/../2/b", "/o/1", None), ("/o/x/../1/b", "/o/1", "b"), ("/o/1", "/o/1", None), ("", "/o/1", None), (".", "/o/1", None), ("..", "/o/1", None),
    ("/etc/a", "/o/1", None), (None, "/o/1", None), ("/../o/1/c", "/o/1", "c"), ("....", "/o/1", "....")])
def test_paths_stay_below_their_folder(spark, path, folder, want):
    row = spark.createDataFrame([(path, folder)], "p string, f string").select(select.confined(F.col("p"), F.col("f")).alias("x")).first()
    assert row["x"] == want


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances(spark):
    rnd = random.Random(4)
    pairs = [("", ""), ("a", ""), ("", "bc"), ("kitten", "sitting"), ("\U0001F600x", "x\U0001F600"), ("a" * 70, "a" * 3)]
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90)))
        b = list(a)
        for _ in range(rnd.randint(0, 20)):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(["", "a", "cc", "x"])
        pairs.append((a, "".join(b)))
    for a, b in pairs:
        ins, dels, subs = kernels.edit_counts(a, b)
        assert kernels.edit_distance(a, b) == plain(a, b) == ins + dels + subs and ins - dels == len(b) - len(a)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    other = long[:9000] + "zz" + long[9050:]
    frame = spark.createDataFrame([*pairs, (long, other), (None, "a"), ("a", None)], "a string, b string")
    for r in frame.withColumn("d", ql.edit_distance(F.col("a"), F.col("b"))).collect():
        assert r["d"] == (None if None in (r["a"], r["b"]) else plain(r["a"], r["b"]) if len(r["a"]) < 1000 else 50)
    rated = ql.within_rate(frame.filter("a <> '' AND b <> ''"), "a", "b", 0.15).select("reference_normalized", "hypothesis_normalized", "pass", "distance")
    for r in rated.collect():
        x, y = r["reference_normalized"], r["hypothesis_normalized"]
        assert r["pass"] == ((plain(x, y) if len(x) < 1000 else 50) / max(len(x), 1) <= 0.15)


def split_of(a, b):
    """Insertions, deletions, substitutions of the cheapest alignment, of those with the fewest insertions."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            new.append(min((row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1] + 1), (row[j - 1][0] + (x != y), row[j - 1][1])))
        row = new
    distance, insertions = row[-1]
    deletions = insertions - len(b) + len(a)
    return insertions, deletions, distance - insertions - deletions


def test_edits_of_many_pairs_are_those_of_each():
    """Pairs of all sizes together: equal ones, empty ones, few edits, and more than a first band has room for."""
    rnd = random.Random(7)
    pairs = [("", ""), ("same", "same"), ("", "abc"), ("abc", ""), ("ab" * 60, "ba" * 60), ("a" * 150, "b" * 90), ("x\ud800y", "xy")]
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 4, 30, 120])))
        near = "".join(rnd.choice(["", c, c + "b", "c"]) if rnd.random() < 0.1 else c for c in a)
        pairs.append((a, near if rnd.random() < 0.7 else "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 120)))))
    assert kernels.edit_counts_of(pairs) == [split_of(a, b) for a, b in pairs]
    assert kernels.edit_counts_of([]) == []


def test_segments_as_a_table_function(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One sentence. " * 200)], "id int, text string")
    rows = spark.sql("SELECT id, s.* FROM {docs} d, LATERAL segment_text(d.text) s ORDER BY seg_index", docs=docs).collect()
    assert {r["id"] for r in rows} == {3} and [r["seg_index"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 5
    assert " ".join(r["text"] for r in rows) == ("One sentence. " * 200).strip()


def test_broken_lengths_do_not_end_a_job(spark):
    rows = [(1, i, v) for i, v in enumerate([1.0, 2.0, float("nan"), 4.0])] + [(2, 0, None), (2, 1, 1.0), (3, 0, 1e300), (3, 1, 1.0), (4, 0, -float("inf")), (5, 0, 0.5), (5, 1, 0.25)]
    marks = order.chapter_markers(spark.createDataFrame(rows, "b int, i int, duration double"), ["b"], ["i"], parts=3)
    found = {(r["b"], r["i"]): (r["start_ms"], r["end_ms"]) for r in marks.collect()}
    known = {(1, 0): (0, 1000), (1, 1): (1000, 3000), (5, 0): (0, 500), (5, 1): (500, 750)}
    assert all(found[k] == known.get(k, (None, None)) for k in found) and len(found) == len(rows)
    clip = spark.createDataFrame([(1, 0, 0.0, 1e300, 1e300), (1, 1, 0.0, 5.0, 9.0), (1, 2, 0.0, float("inf"), 9.0), (1, 3, 0.0, 58.0, 99.0)], "k int, i int, start double, end double, duration double")
    assert [r["error"] for r in clips.check_ranges(clip, ["k"], "i").orderBy("i").collect()] == ["source_too_long", None, "invalid_range", "selection_too_long"]
