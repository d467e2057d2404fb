"""Streams over several triggers: keyed tables, expiry, late rows, repeated triggers, hot keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.cache import latest_state
from lectern.streaming import jobs as st
from lectern.sources.store import KeyedStore, feed, newest, totals

LOG = "id long, at long, status string"


def log(spark, rows, seed=0):
    rnd = random.Random(seed)
    return spark.createDataFrame([(rnd.randint(0, 40) or None, i * 7 % rows, rnd.choice("abc")) for i in range(rows)], LOG)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: [(v is not None, v) for v in r])


def slices(frame, number):
    return st.arrivals(frame, F.floor(F.col("at") * number / 400), number)


def test_latest_state_is_kept_over_triggers(spark, tmp_path):
    frame = log(spark, 400)
    store = st.latest_store(spark, str(tmp_path / "state"), frame, ["id"], ["at", "status"], buckets=5)
    seen = []
    feed(slices(frame, 5), store, str(tmp_path / "marks"), seen.append)
    assert len(seen) == 5 and rows_of(store.read()) == rows_of(latest_state(frame, "id", stamp=["at", "status"]))
    # two versions of a bucket at most, whatever the number of triggers
    folders = {p.parent for p in (tmp_path / "state" / "data").rglob("*.parquet")}
    assert len(folders) <= 2 * 5


def test_repeated_triggers_change_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "id long, n long")
    store = KeyedStore(spark, str(tmp_path), frame.schema, ("id",), totals(["id"]), buckets=2)
    assert rows_of(store.read()) == [] and store.last() == -1
    assert store.merge(frame, 0) and not store.merge(frame, 0) and rows_of(store.read()) == [(1, 5), (2, 5)]
    assert store.merge(frame.filter("id = 1"), 1) and rows_of(store.read()) == [(1, 10), (2, 5)]
    assert store.merge(frame.limit(0), 2) and store.last() == 2 and rows_of(store.read()) == [(1, 10), (2, 5)]


def test_a_trigger_that_dies_before_it_publishes_is_done_over(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, 1) for i in range(20)], "id long, n long")
    store = KeyedStore(spark, str(tmp_path), frame.schema, ("id",), totals(["id"]), buckets=3)
    store.merge(frame, 0)
    write = KeyedStore._write

    def dies(self, rows, place, *parts):
        if place == "pointer":
            raise RuntimeError("driver lost")
        write(self, rows, place, *parts)

    monkeypatch.setattr(KeyedStore, "_write", dies)
    with pytest.raises(RuntimeError):
        store.merge(frame, 1)
    assert rows_of(store.read()) == [(i, 1) for i in range(20)]  # readers see the trigger before
    monkeypatch.setattr(KeyedStore, "_write", write)
    assert store.merge(frame, 1) and rows_of(store.read()) == [(i, 2) for i in range(20)]


def test_rows_leave_a_store_that_keeps_only_some(spark, tmp_path):
    frame = spark.createDataFrame([(i, i) for i in range(30)], "id long, at long")
    store = KeyedStore(spark, str(tmp_path), frame.schema, ("id",), newest(["id"], ["at"]), buckets=1, keep=F.col("at") >= 25)
    store.merge(frame, 0)
    assert rows_of(store.read()) == [(i, i) for i in range(25, 30)]


def test_ids_count_again_after_a_gap_and_state_expires(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), start + dt.timedelta(minutes=m)) for m in range(0, 6000, 3)]
    rows += [(9, start), (9, start + dt.timedelta(hours=1)), (9, start + dt.timedelta(hours=2, seconds=1))]  # a gap of exactly the delay is none
    frame = spark.createDataFrame(rows, "id int, ts timestamp")
    late = spark.createDataFrame([(7, start)], frame.schema)
    path = str(tmp_path / "in")
    for k in range(6):
        part = frame.filter((F.col("ts") >= start + dt.timedelta(minutes=1000 * k)) & (F.col("ts") < start + dt.timedelta(minutes=1000 * (k + 1))))
        (part.unionByName(late) if k == 4 else part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stretches = st.stream_dedupe_ids(stream, "id", "ts", "1 hour", "2 hours")
    query = (stretches.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    found = spark.read.schema(stretches.schema).parquet(str(tmp_path / "out"))
    watermark = max(t for _, t in rows) - dt.timedelta(hours=2)
    want = [r for r in rows_of(st.dedupe_ids_batch(frame, "id", "ts", "1 hour")) if r[2] + dt.timedelta(hours=1) <= watermark]
    assert rows_of(found) == want and len(want) > 20  # the late row is in none
    assert [r[3] for r in want if r[0] == 9] == [2, 1]
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    assert len(progress) >= 6 and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 10  # what is open now, not the history


def test_a_hot_id_is_spread_and_budgets_are_carried(spark, tmp_path):
    fields = "id long, seq long, kind string, policy string"
    rnd = random.Random(8)
    rows = [(1 if rnd.random() < .9 else rnd.randint(2, 9), i, rnd.choices(["failed", "completed", "requested"], (8, 1, 1))[0], str(i // 900)) for i in range(3000)]
    frame = spark.createDataFrame(rows, fields)
    store = st.budget_store(spark, str(tmp_path / "budgets"), buckets=2)
    found = st.retry_budget(st.arrivals(frame, F.floor(F.col("seq") / 1000), 3), store, str(tmp_path / "spent"), str(tmp_path / "marks"))
    want = rows_of(st.retry_budget_batch(frame))
    assert rows_of(found) == want and len(want) > 100


def test_live_progress_is_that_of_the_finished_run(spark, tmp_path):
    from lectern.operators import rollup
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 30), rnd.choice(["completed", "failed"]), rnd.randint(1, 50), 1.5, rnd.random(), rnd.choice([0, 2]), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "book int, segment_id int, status string, chars int, duration double, generation_seconds double, elapsed_seconds int, at int")
    plan = spark.createDataFrame([(b, s % 40, 3) for b in range(4) for s in range(60)], "book int, segment_id int, chars int")
    store = st.progress_store(spark, str(tmp_path / "p"), frame, ["book"], buckets=3)
    shown = []
    feed(st.outcomes(st.arrivals(frame, F.floor(F.col("at") / 75), 4), ["book"]), store, str(tmp_path / "m"),
         lambda n: shown.append(st.live_progress(store.read(), plan, ["book"]).agg(F.sum("completed")).first()[0]))
    assert shown == sorted(shown) and len(set(shown)) >= 3
    done = F.col("status") == "completed"
    runs = frame.groupBy("book").agg(F.count_if(done).alias("generated"), F.sum(F.when(done, F.col("chars"))).alias("generated_chars"), F.sum("generation_seconds").alias("generation_seconds"),
                                     F.sum("duration").alias("audio_seconds"), F.sum("elapsed_seconds").alias("elapsed_seconds"))
    want = rollup.progress_metrics(plan, frame.filter(done).select("book", "segment_id").distinct(), runs, "book")
    columns = ["book", "total", "completed", "remaining_chars", "rtf", "audio_seconds_per_second", "segments_per_minute", "eta_seconds"]
    for a, b in zip(rows_of(st.live_progress(store.read(), plan, ["book"]).select(columns)), rows_of(want.select(columns)), strict=True):
        assert a == pytest.approx(b)
