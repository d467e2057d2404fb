"""Book, job and run summaries. All are partial aggregates; ratios are null on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), F.when(denominator != 0, denominator).cast("double"))


def plan_summary(segments: DataFrame, *keys: str, chapter: list[str], text: str = "text", spoken: str | None = None,
                 boundary: str | None = "boundary") -> DataFrame:
    """Chapters, segments, characters, spoken characters, hard splits and the longest segment.

    Chapters are counted at their first segment, so no distinct count and a single exchange are needed.
    """
    heard = F.coalesce(F.col(spoken), F.col(text)) if spoken else F.col(text)
    hard = F.count_if(F.col(boundary) == "hard") if boundary else F.lit(0).cast("bigint")
    return segments.groupBy(*keys).agg(
        F.count_if(F.col("seg_index") == 1).alias("chapters"), F.count("*").alias("segments"),
        F.sum(F.length(text)).alias("chars"), F.sum(F.length(heard)).alias("spoken_chars"),
        hard.alias("hard_splits"), F.max(F.length(text)).alias("longest"))


def progress_metrics(plan: DataFrame, done: DataFrame, runs: DataFrame, *keys: str, key: str = "segment_id") -> DataFrame:
    """Progress of a run.

    ``plan``: ``keys, segment_id, chars`` (identities may repeat); ``done``: ``keys, segment_id`` completed, unique;
    ``runs``: ``keys, generated, generated_chars, generation_seconds, audio_seconds, elapsed_seconds``.
    """
    counted = plan.groupBy(*keys, key).agg(F.count("*").alias("_n"), F.sum("chars").alias("_chars"))
    joined = counted.join(done.select(*keys, key, F.lit(True).alias("_done")), [*keys, key], "left")
    finished = F.coalesce(F.col("_done"), F.lit(False))
    totals = joined.groupBy(*keys).agg(
        F.sum("_n").alias("total"), F.coalesce(F.sum(F.when(finished, F.col("_n"))), F.lit(0)).alias("completed"),
        F.coalesce(F.sum(F.when(~finished, F.col("_chars"))), F.lit(0)).alias("remaining_chars"))
    df = totals.join(runs, list(keys), "left")
    elapsed = F.col("elapsed_seconds")
    return (df.withColumn("rtf", ratio(F.col("generation_seconds"), F.col("audio_seconds")))
            .withColumn("audio_seconds_per_second", ratio(F.col("audio_seconds"), elapsed))
            .withColumn("segments_per_minute", ratio(F.col("generated") * 60, elapsed))
            .withColumn("eta_seconds", F.col("remaining_chars") * ratio(elapsed, F.col("generated_chars"))))


def state_summary(state: DataFrame, plan: DataFrame, *keys: str, key: str = "segment_id") -> DataFrame:
    """Counts per status weighted by occurrences; checks and retries unweighted; durations both ways.

    Records whose identity is not in a non-empty plan are ignored. A book without a plan counts each record once; a planned book
    without records counts zero.
    ``state``: ``keys, segment_id, status, qc_pass, cer, retry_count, duration, generation_seconds, chars``.
    """
    counted = plan.groupBy(*keys, key).agg(F.count("*").alias("_n"))
    planned = counted.groupBy(*keys).agg(F.sum("_n").alias("total"))
    # Planned and unplanned records are summed apart, so the plan totals meet at most two rows per book.
    used = state.join(counted, [*keys, key], "left").withColumn("_in", F.col("_n").isNotNull()).withColumn("_w", F.coalesce("_n", F.lit(1)))

    def weighted(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("_w"))), F.lit(0)).alias(status)

    def completed(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == "completed", value)), F.lit(0))

    totals = used.groupBy(*keys, "_in").agg(
        *[weighted(s) for s in ("completed", "failed", "generated", "pending", "running")],
        F.count("qc_pass").alias("qc_checked"), F.count_if(F.col("qc_pass")).alias("qc_passed"),
        F.count_if(~F.col("qc_pass")).alias("qc_failed"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"), F.avg("cer").alias("mean_cer"),
        completed(F.col("duration") * F.col("_w")).alias("audio_seconds"),
        completed(F.col("duration")).alias("synthesized_audio_seconds"),
        completed(F.col("generation_seconds")).alias("generation_seconds"),
        completed(F.col("chars") * F.col("_w")).alias("chars"))
    sums = [c for c in totals.columns if c not in (*keys, "_in", "mean_cer")]
    begun = planned.join(totals.filter("_in").drop("_in"), list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    unplanned = totals.filter(~F.col("_in")).drop("_in").join(planned, list(keys), "left_anti").withColumn("total", F.lit(0).cast("bigint"))
    return (begun.unionByName(unplanned)
            .withColumn("percent", F.coalesce(F.bround(ratio(F.col("completed"), F.col("total")) * 100, 1), F.lit(0.0)))
            .withColumn("rtf", ratio(F.col("generation_seconds"), F.col("synthesized_audio_seconds"))))


def job_rollup(books: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Sum books into jobs, those without books included; the running book's estimate is scaled to the job's remaining characters.

    ``books``: ``job, book_order, status, run_started_at, completed, chars, audio_seconds, synthesized_audio_seconds,
    generation_seconds, run_rtf, eta_seconds, remaining_chars``; ``jobs``: ``job, status, started_at, planned_total,
    planned_chars``.
    """
    facts = jobs.select(job, F.col("status").alias("job_status"), "started_at", "planned_total", "planned_chars")
    joined = facts.join(books, job, "left")
    live = (F.col("job_status").isin("running", "pausing", "cancelling") & (F.col("status") == "running")
            & (F.col("run_started_at") >= F.col("started_at")))
    totals = joined.groupBy(job).agg(
        F.first("job_status").alias("status"), F.first("planned_total").alias("total"),
        F.first("planned_chars").alias("planned_chars"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("completed", "chars", "audio_seconds", "synthesized_audio_seconds", "generation_seconds")],
        F.max_by(F.when(live, F.struct("run_rtf", "eta_seconds", "remaining_chars")), F.when(live, F.col("book_order"))).alias("_live"))
    left = F.greatest(F.lit(0), F.col("planned_chars") - F.col("chars"))
    historical = ratio(F.col("generation_seconds"), F.col("synthesized_audio_seconds"))
    active = F.col("_live").isNotNull()
    percent = F.bround(ratio(F.col("completed"), F.col("total")) * 100, 1)
    usable = F.when(F.col("_live.remaining_chars") > 0, F.col("_live.remaining_chars"))
    return (totals.withColumn("percent", F.when((F.col("status") == "completed") & (F.col("total") > 0), 100.0)
                              .otherwise(F.coalesce(percent, F.lit(0.0))))
            .withColumn("historical_rtf", historical)
            .withColumn("rtf", F.when(active, F.col("_live.run_rtf")).otherwise(historical))
            .withColumn("rtf_source", F.when(active & F.col("_live.run_rtf").isNotNull(), "current_run")
                        .when(~active & historical.isNotNull(), "historical").otherwise("unavailable"))
            .withColumn("eta_seconds", F.when(F.col("status").isin("cancelling", "cancelled"), None)
                        .otherwise(ratio(F.col("_live.eta_seconds"), usable) * left))
            .withColumn("chars_per_second", ratio(usable, F.col("_live.eta_seconds"))).drop("_live"))


def run_benchmark(synthesis: DataFrame, *keys: str) -> DataFrame:
    totals = synthesis.groupBy(*keys).agg(
        F.sum("generation_seconds").alias("generation_seconds"), F.sum("duration").alias("audio_seconds"),
        F.count("*").alias("synthesized_segments"), F.coalesce(F.max("peak_memory_gb"), F.lit(0.0)).alias("peak_memory_gb"))
    return totals.withColumn("rtf", ratio(F.col("generation_seconds"), F.col("audio_seconds")))


def compare_batch_sizes(clips: DataFrame, size: str = "batch_size", baseline: int = 1) -> DataFrame:
    """Per configured batch size: sums, real-time factor, largest batch used, passes, worst error rate and speed-up."""
    per_size = clips.groupBy(size).agg(
        F.sum("generation_seconds").alias("generation_seconds"), F.sum("duration").alias("audio_seconds"),
        F.max("actual_size").alias("actual_max_batch_size"), F.count_if("qc_pass").alias("qc_passed"), F.max("cer").alias("max_cer"))
    base = clips.filter(F.col(size) == baseline).agg(F.sum("generation_seconds"))
    return (per_size.withColumn("_base", base.scalar())
            .withColumn("rtf", ratio(F.col("generation_seconds"), F.col("audio_seconds")))
            .withColumn("speedup", ratio(F.col("_base"), F.col("generation_seconds"))).drop("_base"))


def chapter_status(segments: DataFrame, *keys: str) -> DataFrame:
    """A chapter is completed when all its segments are."""
    done = F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False)))
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum("duration").alias("duration"),
                                       F.when(done, "completed").otherwise("failed").alias("status"))


def book_status(chapters: DataFrame, *keys: str, stopped: Column | None = None) -> DataFrame:
    """A book is completed when all its chapters are; a stop request leaves it pending."""
    done = F.bool_and(F.col("status") == "completed")
    halted = F.bool_or(F.coalesce(stopped, F.lit(False))) if stopped is not None else F.lit(False)
    return chapters.groupBy(*keys).agg(
        F.count("*").alias("chapters"), F.count_if(F.col("status") == "completed").alias("completed_chapters"),
        F.when(halted, "pending").when(done, "completed").otherwise("failed").alias("status"))


def job_outcome(jobs: DataFrame, books: DataFrame, job: str = "job_id") -> DataFrame:
    """Cancelled, else failed, else completed, else paused, else failed.

    ``jobs``: ``job, cancelled, attempt_id, returncode, paused``; ``books``: current book results ``job, status``.
    """
    all_done = books.groupBy(job).agg(F.bool_and(F.col("status") == "completed").alias("_done"))
    df = jobs.join(all_done, job, "left")
    failed = F.coalesce(F.col("returncode") != 0, F.lit(False)) | (F.col("attempt_id").isNotNull() & F.col("returncode").isNull())
    return df.withColumn("outcome", F.when(F.col("cancelled"), "cancelled").when(failed, "failed")
                         .when(F.coalesce("_done", F.lit(False)), "completed").when(F.col("paused"), "paused")
                         .otherwise("failed")).drop("_done")


def retained_rate(audit: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Removed characters against the size before cleaning."""
    removed = audit.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed_chars"))
    return (sizes.join(removed, list(keys), "left").withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0)))
            .withColumn("retained", 1 - ratio(F.col("removed_chars"), F.col("before_chars"))))


def batch_summary(entries: DataFrame) -> DataFrame:
    """One row per input; an error never stops the other inputs. ``entries``: ``source, status, error, segment_verdict``."""
    return entries.groupBy("source").agg(
        F.count_if(F.col("segment_verdict") == "generated").alias("generated"),
        F.count_if(F.col("segment_verdict") == "cached").alias("cached"),
        F.min("error").alias("error"),
        F.when(F.count("error") > 0, "failed").otherwise(
            F.when(F.bool_and(F.coalesce(F.col("segment_verdict").isin("generated", "cached"), F.lit(False))), "completed")
            .otherwise("failed")).alias("status"))

