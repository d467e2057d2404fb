"""Whole runs: operators of several families chained as a user would."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..operators import cache, order, quality, rollup, work
from ..session import stable
from ..sources import writers
from .inputs import LINES, jobs, table
from .registry import query
from .segment_queries import DOC_SEGMENTS
from .state_queries import POLICY, SEGMENT_IDS, line_ids


@query("g2_segment_sql", f"WITH {DOC_SEGMENTS} SELECT k AS doc_id, seg_index, text, boundary FROM segs")
def g2_segment_sql(spark, d):
    """The exact segmentation as a table function of SQL."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, s.seg_index, s.text, s.boundary FROM {documents} d, LATERAL segment_text(d.text) s", documents=table(spark, d, "documents"))


@query("fn_clock", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label FROM (SELECT o_orderkey, floor(o_totalprice / 40)::BIGINT AS s FROM orders)")
def fn_clock(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.clock(F.col("o_totalprice") / 40).alias("label"))


@query("fn_elapsed", "SELECT o_orderkey, epoch(TIMESTAMP '2001-09-01 12:30:00.25' - o_orderdate)::DOUBLE AS elapsed FROM orders")
def fn_elapsed(spark, d):
    end = F.lit("2001-09-01 12:30:00.25").cast("timestamp_ntz")
    return jobs(spark, d).select(F.col("job_id").alias("o_orderkey"), order.elapsed_seconds(F.col("created_at"), end).alias("elapsed"))


def _measure(texts: list[str]) -> list[float]:
    """Stands in for the engine: a tenth of a second per character, and no patience for secrets."""
    if any("token" in t for t in texts):
        raise RuntimeError("refused")
    return [len(t) / 10 for t in texts]


RETRIES = 1

RUN = f"""
WITH {LINES}, {SEGMENT_IDS},
done AS (SELECT DISTINCT i.segment_id FROM ids i JOIN labels l USING (doc_id) WHERE l.quality = 1),
plan AS (SELECT source, segment_id, count(*) AS n, any_value(text) AS text FROM ids GROUP BY ALL),
r AS (SELECT p.*, CASE WHEN d.segment_id IS NOT NULL THEN 'cached' WHEN contains(text, 'token') THEN 'failed' WHEN length(text) / 10 < 0.4 THEN 'failed' ELSE 'generated' END AS verdict
  FROM plan p LEFT JOIN done d USING (segment_id))
"""


def judged_round(pending, texts):
    """One round: batches, scores, verdicts. Batches are planned on narrow rows, which the texts meet for the scorer alone; written first, few of them
    are sent to the texts and not the texts to them."""
    batched = stable(work.plan_batches(pending, ["source", "doc_id"], "line_no", F.col("chars"), 4))
    scored = work.score_batches(batched.join(texts, "row"), _measure, ["source", "doc_id", *work.BATCH_KEY], "item", order="line_no")
    outcome = batched.select("item", "attempt").join(scored.withColumnRenamed("item_id", "item"), "item")
    reasons = F.when(F.col("error").isNotNull(), F.array(F.lit("engine"))).otherwise(quality.speed_reasons(F.lit(0), F.col("score")))
    judged = quality.verdict(outcome.withColumn("reasons", reasons).withColumn("cer", F.lit(None).cast("double")))
    return judged.select("item", "attempt", F.col("pass").alias("passed"), "reasons", "error")


def outcomes(spark, d):
    """Plan, identify, skip finished work, batch, score and judge: the fate of every segment of a book (the source).

    The plan, the items with their verdicts and the outcome are written once; what reads them does not run them again. A line has a number, by which an
    item is known within the run; identities move as their bytes, and texts only to the scorer.
    """
    lines = line_ids(spark, d).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "line_no", "text", F.unhex("segment_id").alias("id"))
    planned = stable(lines)
    finished = planned.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    state = finished.select("id").distinct().select(
        "id", F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(POLICY).alias("qc_hash"), F.col("id").alias("content_sha256"))
    files = state.select("id", F.col("content_sha256").alias("sha256"))
    decided = cache.classify_segments(planned, state, files, POLICY, "id").select("id", "verdict")

    first = F.min(F.struct("doc_id", "line_no", "row", F.length("text").alias("chars"))).alias("_s")
    unique = planned.groupBy("source", "id").agg(F.count("*").alias("n"), first)
    work_items = stable(unique.join(decided, "id").select("source", "id", "n", "_s.*", "verdict", F.col("_s.row").cast("string").alias("item")))
    pending = work_items.filter(F.col("verdict") == "pending").select("item", "row", "source", "doc_id", "line_no", "chars")
    # an engine is costly and need not be deterministic: the answers of a round are written once, and only what failed is asked again
    texts = planned.select("row", "text")
    judged = work.retry_loop(pending, lambda left, number: judged_round(left, texts), "item", RETRIES).select("item", "passed")

    rows = work_items.select("item", "source", "id", "n", "verdict", "chars").join(judged, "item", "left")
    fate = F.when(F.col("verdict") == "cached", "cached").when(F.col("passed"), "generated").otherwise("failed")
    return stable(rows.select("source", F.lower(F.hex("id")).alias("segment_id"), "n", fate.alias("fate"), "chars"))


@query("convert_run", f"""{RUN} SELECT source, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (verdict = 'cached'), 0)::BIGINT AS cached, coalesce(sum(n) FILTER (verdict = 'generated'), 0)::BIGINT AS generated,
  coalesce(sum(n) FILTER (verdict = 'failed'), 0)::BIGINT AS failed, coalesce(sum(length(text)) FILTER (verdict = 'generated'), 0)::BIGINT AS generated_chars,
  CASE WHEN bool_and(verdict <> 'failed') THEN 'completed' ELSE 'failed' END AS status FROM r GROUP BY 1""")
def convert_run(spark, d):
    """A run's summary per book."""
    rows = outcomes(spark, d)

    def weight(kind: str, value):
        return F.coalesce(F.sum(F.when(F.col("fate") == kind, value)), F.lit(0)).cast("bigint")

    books = rollup.book_status(rows.withColumn("status", F.when(F.col("fate") == "failed", "failed").otherwise("completed")), "source")
    totals = rows.groupBy("source").agg(
        F.sum("n").alias("total"), weight("cached", F.col("n")).alias("cached"), weight("generated", F.col("n")).alias("generated"),
        weight("failed", F.col("n")).alias("failed"), weight("generated", F.col("chars")).alias("generated_chars"))
    return totals.join(books.select("source", "status"), "source")


@query("convert_failures", f"{RUN} SELECT source, segment_id, n FROM r WHERE verdict = 'failed'")
def convert_failures(spark, d):
    """What a run could not produce, as its failure report lists it: refused by the engine, or judged too short."""
    rows = outcomes(spark, d).withColumn("status", F.when(F.col("fate") == "failed", "failed").otherwise("completed"))
    return writers.failures(rows).select("source", "segment_id", "n")
