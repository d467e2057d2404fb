"""Sinks: cleaned text, manifests, reports and superseded exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS_PER_ROW = 1000


def chapter_texts(chapters: DataFrame, segments: DataFrame, book: str = "book_id", text: str = "text") -> DataFrame:
    """Clean text per chapter, and a spoken variant only where some segment differs."""
    keys = [book, "chapter_index"]
    plain = chapters.select(*keys, F.lit("clean").alias("variant"), F.col(text).alias("content"))
    grouped = segments.groupBy(*keys).agg(
        F.bool_or(F.col("spoken_text") != F.col("text")).alias("_differs"),
        F.array_sort(F.collect_list(F.struct("seg_index", F.coalesce("spoken_text", "text").alias("t")))).alias("_all"))
    spoken = grouped.filter("_differs").select(
        *keys, F.lit("spoken").alias("variant"), F.array_join(F.transform("_all", lambda s: s["t"]), "\n\n").alias("content"))
    return plain.unionByName(spoken)


def write_text(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by variant, not by book: one folder per book would mean one small file per book and task."""
    texts.write.mode(mode).partitionBy("variant").parquet(path)


def manifest_rows(books: DataFrame, segments: DataFrame, book: str = "book_id") -> DataFrame:
    """Nested chapter documents of a manifest: ``book, chapter_index, part, segments ARRAY<STRUCT>``.

    A chapter's segments are cut into parts of 1000, so no row grows with the size of a chapter or book.
    """
    part = F.floor((F.col("seg_index") - 1) / SEGMENTS_PER_ROW).cast("int")
    fields = [c for c in segments.columns if c not in (book, "chapter_index", "title")]
    nested = (segments.withColumn("part", part).groupBy(book, "chapter_index", "part")
              .agg(F.array_sort(F.collect_list(F.struct("seg_index", *[f for f in fields if f != "seg_index"]))).alias("segments")))
    return nested.join(books, book)


def write_manifest(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def qc_report(segments: DataFrame, *keys: str) -> DataFrame:
    kept = ["seg_index", "segment_id", "status", "qc", "error", "history"]
    return segments.select(*keys, *[c for c in kept if c in segments.columns])


def failures(segments: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """Segments that are not completed, followed by failed chapter or book stages."""
    failed = segments.filter(~F.coalesce(F.col("status") == "completed", F.lit(False)))
    return failed if stages is None else failed.unionByName(stages, allowMissingColumns=True)


def write_reports(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)


def write_exports(exports: DataFrame, path: str) -> None:
    """Exports live under their run signature, so a new run never overwrites an older one; writing a run again replaces its own. A call brings all
    exports of the signatures in it. Readers that must not see half a run use ``publish``."""
    (exports.withColumn("signature16", F.left("signature", F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("signature16").parquet(path))


def supersede(exports: DataFrame, runs: DataFrame, book: str = "book_id", stamp: Column | str = "run_at") -> DataFrame:
    """Where each export stands: under its book if its signature is the latest run's, else under ``previous``."""
    latest = runs.groupBy(book).agg(F.max_by("signature", stamp).alias("_latest"))
    current = F.col("signature") == F.col("_latest")  # unknown for a book without a run, whose exports then are earlier ones
    place = F.when(current, F.col("path")).otherwise(
        F.concat(F.lit("previous/"), F.left("signature", F.lit(16)), F.lit("/"), F.col("path")))
    return exports.join(latest, book, "left").withColumn("current", F.coalesce(current, F.lit(False))).withColumn("location", place).drop("_latest")
