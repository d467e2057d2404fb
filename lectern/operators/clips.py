"""Reference clips: ranges, edge trimming, level warnings, gain and joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import samples as sm
from . import quality
from .scan import LARGEST, running


def check_ranges(clips: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end",
                 duration: str = "duration", **scan) -> DataFrame:
    """Per clip the first broken rule: range, source length, or the running total of selected seconds."""
    s, e, d = (F.col(c).cast("double") for c in (start, end, duration))
    finite = ~(F.isnan(s) | F.isnan(e) | F.isnan(d)) & (F.greatest(F.abs(s), F.abs(e), F.abs(d)) < float("inf"))
    in_range = finite & (s >= 0) & (s < e) & (e <= d + fixed.RANGE_SLACK)
    # a range that is no range of numbers selects nothing
    seconds = F.when(finite & (F.abs(e) < LARGEST) & (F.abs(s) < LARGEST), e - s).otherwise(0.0)
    total = running(clips, keys, [order], {"selected_seconds": seconds, "clip_no": F.lit(1).cast("bigint")}, **scan)
    error = (F.when(~F.coalesce(in_range, F.lit(False)), "invalid_range")
             .when(d > fixed.SOURCE_SECONDS, "source_too_long")
             .when(F.col("clip_no") > fixed.CLIP_LIMIT, "too_many_clips")
             .when(F.col("selected_seconds") > fixed.REFERENCE_SECONDS, "selection_too_long"))
    return total.withColumn("error", error)


def audible_bounds(samples: Column, rate: Column, floor: float = fixed.EDGE_FLOOR, relative: float = fixed.EDGE_SHARE,
                   pad_seconds: float = fixed.EDGE_PAD) -> Column:
    """``struct<first,last>``: 0-based first kept sample and end (exclusive), padded around the audible stretch."""
    return sm.audible(floor, relative, pad_seconds)(samples, rate.cast("bigint"))


def trim_edges(clips: DataFrame, samples: str = "samples", rate: str = "rate", **limits) -> DataFrame:
    df = clips.withColumn("_b", audible_bounds(F.col(samples), F.col(rate), **limits))
    length = F.col("_b.last") - F.col("_b.first")
    return (df.withColumn("first", F.col("_b.first")).withColumn("last", F.col("_b.last"))
            .withColumn("trimmed", F.slice(samples, (F.col("_b.first") + 1).cast("int"), length.cast("int")))
            .withColumn("trimmed_seconds", length / F.col(rate))
            .withColumn("too_short", F.coalesce(F.col("trimmed_seconds") < fixed.MIN_CLIP_SECONDS, F.lit(True))).drop("_b"))


def level_warnings(samples: Column, original: Column | None = None, clipped: float = fixed.REFERENCE_CLIPPED_LEVEL,
                   clipped_share: float = fixed.REFERENCE_CLIPPED_SHARE, quiet: float = fixed.QUIET_RMS,
                   silent: float = fixed.SILENT_SAMPLE, silent_share: float = fixed.SILENT_SHARE) -> Column:
    """Warnings in order; clipping is judged on the untrimmed samples. Empty for a null or empty clip."""
    own = quality.measures(samples, clipped=clipped, silent=silent)
    whole = own if original is None else quality.measures(original, clipped=clipped)

    def judge(m: Column) -> Column:
        return F.array_compact(F.array(F.when(m["whole"]["clipped"] > clipped_share, "clipping"), F.when(m["own"]["rms"] < quiet, "quiet"),
                                       F.when(m["own"]["silent"] > silent_share, "silence")))

    # a list of one, so that the measures are taken once
    return F.element_at(F.transform(F.array(F.struct(own.alias("own"), whole.alias("whole"))), judge), 1)


def is_silent(samples: Column) -> Column:
    return quality.peak(samples) < fixed.SILENT_PEAK


def gain(samples: Column) -> Column:
    """Null for an empty clip; the ceiling for one without any sound."""
    loudest = quality.peak(samples)
    return F.when(loudest == 0, fixed.GAIN_CEILING).otherwise(F.least(F.lit(fixed.GAIN_CEILING), fixed.GAIN_PEAK / F.nullif(loudest, F.lit(0.0))))


def apply_gain(samples: Column) -> Column:
    return sm.scaled(samples, gain(samples).cast("double"))


def join_clips(clips: DataFrame, keys: list[str], order: str, samples: str = "samples", text: str = "text",
               rate: int = fixed.REFERENCE_RATE) -> DataFrame:
    """Ordered concatenation with a gap of silence between clips, texts on separate lines, and length warnings.

    Only references of at most five clips are joined; larger groups are returned with an error and without samples. The
    rank filter runs before the shuffle too, so a group of any size ships at most five clips per task.
    """
    counts = clips.groupBy(*keys).agg(F.count("*").alias("clips"))
    first = clips.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= fixed.CLIP_LIMIT)
    small = first.join(counts.filter(F.col("clips") <= fixed.CLIP_LIMIT), keys)
    gap = F.array_repeat(F.lit(0.0), int(rate * fixed.GAP_SECONDS))
    grouped = small.groupBy(*keys, "clips").agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(samples).cast("array<double>").alias("s"), F.col(text).alias("t")))).alias("_all"))
    parts = F.transform("_all", lambda c, i: F.when(i == 0, c["s"]).otherwise(F.concat(gap, c["s"])))
    joined = (grouped.withColumn("samples", F.flatten(parts))
              .withColumn("text", F.array_join(F.transform("_all", lambda c: c["t"]), "\n")).drop("_all"))
    seconds = F.size("samples") / F.lit(rate)
    joined = (joined.withColumn("duration", seconds)
              .withColumn("warnings", F.array_compact(F.array(F.when(seconds < fixed.SHORT_SECONDS, "short"),
                                                              F.when(seconds > fixed.LONG_SECONDS, "long"))))
              .withColumn("error", F.when(seconds > fixed.REFERENCE_SECONDS, "reference_too_long")))
    large = counts.filter(F.col("clips") > fixed.CLIP_LIMIT).withColumn("error", F.lit("too_many_clips"))
    return joined.unionByName(large, allowMissingColumns=True)
