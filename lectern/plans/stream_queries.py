"""Streaming queries (ST-*), run to the end of the table and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workspace
from ..streaming import jobs as st
from ..sources.store import feed
from .inputs import RECORDS, records, small_batches, sql_tidy, table
from .job_queries import RECEIPTS, attempted_jobs
from .registry import ORACLES, query
from .segment_queries import sql_segments

SLICES = 5


def arriving(rows: DataFrame, column: str, late=None) -> DataFrame:
    """A table in ``SLICES`` arrivals of equal spans of ``column``. Rows that are ``late`` come three slices after their own, if there are three more
    (a trigger drops what is behind the watermark two triggers before it)."""
    timed = rows.schema[column].dataType.typeName().startswith("timestamp")
    value = (F.unix_micros(F.col(column).cast("timestamp")) if timed else F.col(column)).cast("double")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    own = F.least(F.floor((value - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1e-9)) * SLICES), F.lit(SLICES - 1)).cast("int")
    if late is not None:
        own = F.when(late & (own < SLICES - 3), own + 3).otherwise(own)
    return st.arrivals(rows, F.coalesce(own, F.lit(0)), SLICES)


def streamed_records(spark, d) -> DataFrame:
    status = (F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed")
              .when(F.col("l_linestatus") == "O", "generated").otherwise("pending"))
    return st.read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("seg_index"), F.col("l_partkey").alias("segment_id"),
        F.col("l_suppkey").alias("supplier"), status.alias("status"), F.col("l_quantity").alias("duration"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.round(F.col("l_discount") * 100).cast("bigint").alias("discount"),
        F.col("l_shipdate").alias("shipped_at"))


@query("st1_stream_segments", f"""
WITH {sql_segments(f"SELECT doc_id AS k, {sql_tidy('text')} AS text FROM documents")} SELECT k AS doc_id, seg_index, text, boundary FROM segs""")
def st1_stream_segments(spark, d):
    small_batches(spark)
    docs = st.read_table(spark, d, "documents").select("doc_id", "text")
    rows = st.drain(st.stream_segments(docs, "doc_id"))
    return rows.select("doc_id", F.col("seg_index").cast("bigint").alias("seg_index"), "text", "boundary")


_LATEST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1"


@query("st2_stream_latest_state", _LATEST)
def st2_stream_latest_state(spark, d):
    """A streaming aggregate in update mode."""
    log = st.read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return st.drain(st.stream_latest_state(log, ["user_id"], ["ts", "event_id"]), "update", ["user_id"]).drop("ts")


@query("st2_stream_latest_store", _LATEST)
def st2_stream_latest_store(spark, d):
    """Five arrivals merged into a keyed table, which holds current rows only."""
    log = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    store = st.latest_store(spark, workspace(spark), log, ["user_id"], ["ts", "event_id"])
    feed(arriving(log, "ts"), store, workspace(spark))
    return store.read().drop("ts")


@query("st3_stream_dedupe_ids", "SELECT DISTINCT user_id FROM events")
def st3_stream_dedupe_ids(spark, d):
    """Exact: an id is remembered for good."""
    return st.drain(st.stream_dedupe_ids(st.read_table(spark, d, "events").select("user_id"), "user_id"))


_STRETCHES = """
s AS (SELECT *, coalesce(t > lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) + 28800000000, true)::INT AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM s)
SELECT user_id, make_timestamp(min(t)) AS first_seen, make_timestamp(max(t)) AS last_seen, count(*) AS occurrences FROM r GROUP BY user_id, stretch"""


@query("st3_stream_dedupe_recent", f"""
WITH a AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, min(ts) OVER () AS low, max(ts) OVER () AS high, max(epoch_us(ts)) OVER () AS top FROM events),
b AS (SELECT *, least(floor((epoch_us(ts) - epoch_us(low))::DOUBLE / (epoch_us(high) - epoch_us(low))::DOUBLE * {SLICES}), {SLICES - 1}) AS slice FROM a),
e AS (SELECT user_id, event_id, t, top FROM b WHERE NOT (event_id % 50 = 7 AND slice < {SLICES - 3})),
{_STRETCHES} HAVING max(t) + 28800000000 <= any_value(top) - 86400000000""")
def st3_stream_dedupe_recent(spark, d):
    """An id counts again after eight quiet hours. Five arrivals; some rows come days late and are left out; state lives for a day and a third."""
    items = table(spark, d, "events").select("user_id", "event_id", "ts")
    return st.drain(st.stream_dedupe_ids(arriving(items, "ts", F.col("event_id") % 50 == 7), "user_id", "ts", "8 hours", "1 day"))


@query("st3_dedupe_recent_batch", f"WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), {_STRETCHES}")
def st3_dedupe_recent_batch(spark, d):
    return st.dedupe_ids_batch(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "8 hours")


@query("st4_stream_progress", f"""
WITH {RECORDS} SELECT supplier, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, coalesce(sum(cents) FILTER (status = 'completed'), 0)::BIGINT AS generated_chars,
  coalesce(sum(cents) FILTER (status <> 'completed'), 0)::BIGINT AS remaining_chars, sum(discount)::BIGINT AS generation_seconds, sum(duration) AS audio_seconds,
  sum(discount)::DOUBLE / nullif(sum(duration), 0) AS rtf FROM records GROUP BY 1""")
def st4_stream_progress(spark, d):
    rows = streamed_records(spark, d).withColumnRenamed("cents", "chars").withColumnRenamed("discount", "generation_seconds")
    return st.progress_ratios(st.drain(st.stream_progress(rows, "supplier"), "update", ["supplier"]))


def live_records(spark, d) -> DataFrame:
    rec = records(spark, d)
    clock = F.when(F.col("tax") > 7, F.col("tax")).otherwise(0)
    return rec.select("supplier", "segment_id", "status", F.col("cents").alias("chars"), "duration", F.col("discount").alias("generation_seconds"), clock.alias("elapsed_seconds"), "shipped_at")


@query("st4_live_progress", ORACLES["a2_progress_metrics"])
def st4_live_progress(spark, d):
    """What is left, rates and the time to go, after the last of five arrivals."""
    rows = live_records(spark, d)
    plan = rows.select("supplier", "segment_id", "chars")
    store = st.progress_store(spark, workspace(spark), rows, ["supplier"])
    feed(st.outcomes(arriving(rows.withColumn("at", F.unix_date(F.col("shipped_at").cast("date"))), "at"), ["supplier"]), store, workspace(spark))
    found = st.live_progress(store.read(), plan, ["supplier"])
    return found.select("supplier", "total", "completed", "remaining_chars", "rtf", "audio_seconds_per_second", "segments_per_minute", "eta_seconds")


_BUDGET = """
WITH a AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 'completed' ELSE 'failed' END AS kind, (event_id // 400)::VARCHAR AS policy FROM events),
r AS (SELECT *, (kind <> 'failed' OR coalesce(lag(policy) OVER (PARTITION BY id ORDER BY seq) <> policy, false))::INT AS reset FROM a),
e AS (SELECT *, sum(reset) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY id, epoch ORDER BY seq) AS n FROM e WHERE kind = 'failed')
SELECT id, epoch::INTEGER AS epoch, seq FROM n WHERE n = 4"""


def _attempts(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "completed").otherwise("failed")
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"),
                         F.floor(F.col("event_id") / 400).cast("bigint").cast("string").alias("policy"))


@query("st5_retry_budget", _BUDGET)
def st5_retry_budget(spark, d):
    """Five arrivals; budgets in between in a keyed table."""
    attempts = _attempts(table(spark, d, "events"))
    return st.retry_budget(arriving(attempts, "seq"), st.budget_store(spark, workspace(spark)), workspace(spark), workspace(spark))


@query("st5_retry_budget_batch", _BUDGET)
def st5_retry_budget_batch(spark, d):
    return st.retry_budget_batch(_attempts(spark.read.parquet(f"{d}/events.parquet")))


@query("st6_stale_events", RECEIPTS)
def st6_stale_events(spark, d):
    """Five arrivals against the job table."""
    rows = records(spark, d).drop("tax")
    receipts = arriving(rows.withColumn("at", F.unix_date(F.col("shipped_at").cast("date"))), "at").withColumn("attempt_id", F.col("seg_index") % 3).withColumnRenamed("shipped_at", "updated_at")
    return st.drain(st.stale_events(receipts, attempted_jobs(spark, d)).select("job_id", "seg_index", "segment_id", "cents"))



