"""Markers, queues and top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .scan import position, running


def chapter_markers(chapters: DataFrame, book: list[str], order: list[str], duration: str = "duration", **scan) -> DataFrame:
    """Start and end of each chapter in milliseconds, rounded half to even from the running total.

    Where a length is unknown (null, NaN, infinite, or no length at all), the marks of that chapter and of all later ones are null.
    """
    df = running(chapters, book, order, {"_end": F.coalesce(F.col(duration).cast("double"), F.lit(float("nan")))}, **scan)
    start = F.col("_end") - F.col(duration)
    return (df.withColumn("start_ms", F.bround(start * 1000).cast("bigint"))
            .withColumn("end_ms", F.bround(F.col("_end") * 1000).cast("bigint")).drop("_end"))


def total_check(books: DataFrame, chapters: DataFrame, key: str, total: str = "total", markers: str = "markers") -> DataFrame:
    """Whether the delivered length and the marker count agree with the chapters; a book without chapters has none of either."""
    sums = chapters.groupBy(key).agg(F.sum("duration").alias("chapter_seconds"), F.count("*").alias("chapter_count"))
    slack = F.greatest(F.lit(1.0), F.col("chapter_seconds") * 0.001)
    return (books.join(sums, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chapter_seconds", "chapter_count")})
            .withColumn("length_ok", F.abs(F.col(total) - F.col("chapter_seconds")) <= slack)
            .withColumn("markers_ok", F.col(markers) == F.col("chapter_count")))


def queue_position(jobs: DataFrame, job: str = "job_id", **scan) -> DataFrame:
    """Position of each queued job in one global order."""
    queued = (jobs.filter(F.col("status") == "queued")
              .withColumn("_order", F.coalesce("queue_order", F.lit(0)))
              .withColumn("_since", F.coalesce("queued_at", "created_at")))
    return position(queued, [], ["_order", "_since", job], "queue_position", **scan).drop("_order", "_since")


def enqueue_bounds(jobs: DataFrame, *scope: str) -> DataFrame:
    """The order numbers that append to the queue or run next."""
    queued = F.when(F.col("status") == "queued", F.coalesce("queue_order", F.lit(0)))
    return jobs.groupBy(*scope).agg((F.coalesce(F.max(queued), F.lit(0)) + 1).alias("append_order"),
                                    (F.coalesce(F.min(queued), F.lit(0)) - 1).alias("next_order"))


def recent_jobs(jobs: DataFrame, created: str = "created_at", job: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.col(created).desc(), F.col(job).desc())


def top_recent(tasks: DataFrame, removed: DataFrame, key: str, stamp: str, n: int = fixed.RECENT_LIMIT) -> DataFrame:
    """The newest tasks that were not removed; a top-k, not a sort."""
    return tasks.join(removed.select(key).distinct(), key, "left_anti").orderBy(F.col(stamp).desc(), F.col(key)).limit(n)


def shown_list(df: DataFrame, keys: list[str], value: str, k: int = fixed.SHOWN_CHAPTERS) -> DataFrame:
    """The first ``k`` values per key in order, with the total. Only ``k`` rows per key and task are shuffled."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= k)
    lists = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ",").alias("_l"))
    label = F.when(F.col("total") > k, F.concat("_l", F.lit("…"))).otherwise(F.col("_l"))
    return lists.join(totals, keys).select(*keys, label.alias("shown"), "total")


def pause_after(boundary: Column, pauses: dict[str, float] = fixed.PAUSES) -> Column:
    """Seconds of silence after a segment."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in pauses.items() for x in pair]), boundary)


def delivered_seconds(segments: DataFrame, *keys: str, rate: float = 1.0) -> DataFrame:
    return segments.groupBy(*keys).agg(F.sum(F.col("duration") / rate + pause_after(F.col("boundary"))).alias("delivered_seconds"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two local timestamps, whatever the session's time zone."""
    def of_day(at: Column) -> Column:
        return F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at)
    return (F.datediff(F.to_date(end), F.to_date(start)).cast("bigint") * 86400 + of_day(end) - of_day(start)).cast("double")


def log_tail(lines: DataFrame, key: str, order: str, n: int = fixed.LOG_LINES, size: str = "bytes", limit: int = fixed.LOG_BYTES) -> DataFrame:
    """The last ``n`` lines of each log that also start within its last ``limit`` bytes.

    The rank filter runs before the shuffle too, so a log of any length ships ``n`` lines per task.
    """
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = lines.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n)
    used = F.sum(F.col(size)).over(latest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return last.withColumn("_used", used).filter(F.col("_used") <= limit).drop("_r", "_used")
