"""Runs that are interrupted, repeated and superseded."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.operators import work
from lectern.sources import writers
from lectern.sources.publish import Publication

ROUNDS = 3


def stepper(fails: int = 10):
    """Items pass at their ``need``-th attempt; what is asked is noted."""
    asked = []

    def step(pending, number):
        asked.append(sorted((r["id"], r["attempt"]) for r in pending.collect()))
        if len(asked) == fails:
            raise RuntimeError("engine lost")
        return pending.select("id", (F.col("attempt") + 1 >= F.col("need")).alias("passed"), (F.col("attempt") * 10 + F.col("id")).alias("answer"))
    return step, asked


def items(spark, rows):
    return spark.createDataFrame(rows, "id int, need int")


def test_a_run_that_stops_goes_on_with_the_attempts_spent(spark, tmp_path):
    rows = [(1, 1), (2, 2), (3, 3), (4, 9), (None, 1)]
    whole, _ = stepper()
    want = sorted(tuple(r) for r in work.retry_loop(items(spark, rows), whole, "id", 2).select("id", "answer", "attempts", "status").collect())
    assert want == [(1, 1, 1, "completed"), (2, 12, 2, "completed"), (3, 23, 3, "completed"), (4, 24, 3, "exhausted")]
    path = str(tmp_path / "run")
    step, asked = stepper(fails=2)
    with pytest.raises(RuntimeError):
        work.retry_loop(items(spark, rows), step, "id", 2, path)
    again, more = stepper()
    assert work.retry_loop(items(spark, rows), again, "id", 2, path, rounds=1).filter("status = 'pending'").count() == 2
    found = work.retry_loop(items(spark, rows), again, "id", 2, path).select("id", "answer", "attempts", "status")
    assert sorted(tuple(r) for r in found.collect()) == want
    assert asked[0] == [(1, 0), (2, 0), (3, 0), (4, 0)] and more == [[(2, 1), (3, 1), (4, 1)], [(3, 2), (4, 2)]]
    work.retry_loop(items(spark, rows), again, "id", 2, path)
    assert len(more) == 2  # nothing is left to ask
    added = work.retry_loop(items(spark, [*rows, (5, 2)]), again, "id", 2, path)
    assert more[2:] == [[(5, 0)], [(5, 1)]] and {r["id"]: r["attempts"] for r in added.collect()}[5] == 2


def test_a_half_written_round_did_not_happen(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, True, 0)], "id int, passed boolean, attempt int").write.parquet(f"{path}/events/round=0")  # never entered
    step, asked = stepper()
    found = work.retry_loop(items(spark, [(1, 1), (2, 1)]), step, "id", 2, path).collect()
    assert asked == [[(1, 0), (2, 0)]] and {r["status"] for r in found} == {"completed"}
    empty, _ = stepper()
    assert work.retry_loop(items(spark, []), empty, "id", 1).count() == 0


def run(spark, book, signature, day, paths, status="completed", **more):
    at = dt.datetime(2024, 1, day)
    runs = spark.createDataFrame([(book, signature, at, status, 3, [1, 2])], "book_id string, signature string, run_at timestamp, status string, total_chapters long, selected_chapters array<long>")
    exports = spark.createDataFrame([(book, signature, at, "mp3", p, i) for i, p in enumerate(paths)], "book_id string, signature string, run_at timestamp, format string, path string, chapter_index long")
    return runs, exports


def located(store):
    return sorted((r["book_id"], r["current"], r["location"]) for r in store.located().collect())


def test_runs_written_twice_and_runs_over_runs(spark, tmp_path):
    store = Publication(spark, str(tmp_path / "out"))
    assert store.located().count() == 0 and store.manifests().count() == 0
    first = run(spark, "a", "s1" * 20, 1, ["x", "y"])
    store.publish(*first)
    store.publish(*first)
    store.publish(*run(spark, "b", "s9" * 20, 1, ["x"]))
    assert located(store) == [("a", True, "x"), ("a", True, "y"), ("b", True, "x")]
    store.publish(*run(spark, "a", "s2" * 20, 2, ["x"], "failed"))
    previous = "previous/s1s1s1s1s1s1s1s1/"
    assert located(store) == [("a", False, previous + "x"), ("a", False, previous + "y"), ("a", True, "x"), ("b", True, "x")]
    documents = {r["book_id"]: r for r in store.manifests().collect()}
    assert documents["a"]["status"] == "failed" and documents["a"]["signature"] == "s2" * 20 and [e["path"] for e in documents["a"]["exports"]] == ["x"]
    assert documents["a"]["export_scope"] == "selected_chapters" and documents["a"]["complete_book"] is False and documents["a"]["selected_chapters"] == [1, 2]


def test_readers_never_see_half_a_run(spark, tmp_path):
    store = Publication(spark, str(tmp_path / "out"))
    store.publish(*run(spark, "a", "s1", 1, ["x"]))
    runs, exports = run(spark, "a", "s2", 2, ["y"])
    store.exports.merge(exports.select("*", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("sha256")), store.exports.last() + 1)  # and then the driver is lost
    assert located(store) == [("a", True, "x")]
    store.publish(runs, exports)
    assert [x for x in located(store) if x[1]] == [("a", True, "y")]


def test_exports_written_again_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "exports")
    rows = spark.createDataFrame([("a", "s1", "x"), ("a", "s2", "x"), ("b", "s1", "z")], "book_id string, signature string, path string")
    writers.write_exports(rows, path)
    writers.write_exports(rows, path)
    writers.write_exports(rows.filter("signature = 's2'"), path)
    assert spark.read.parquet(path).count() == 3
