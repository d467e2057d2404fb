"""Quality measures and rules. Signal measures run inside the row that holds the samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels
from ..functions import samples as sm
from ..settings import QualityRules
from .clean import normalized_text
from .scan import longest_runs


def compare_text(pairs: DataFrame, reference: str, hypothesis: str, normalize: bool = True) -> DataFrame:
    """Character error rate and similarity of normalised texts."""
    prepared = normalized_text if normalize else (lambda c: c)
    df = (pairs.withColumn("reference_normalized", prepared(F.col(reference)))
          .withColumn("hypothesis_normalized", prepared(F.col(hypothesis))))
    df = df.withColumn("distance", edit_distance(F.col("reference_normalized"), F.col("hypothesis_normalized")))
    n, m = F.length("reference_normalized"), F.length("hypothesis_normalized")
    return (df.withColumn("cer", F.col("distance") / F.greatest(n, F.lit(1)))
            .withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance") / F.greatest(n, m, F.lit(1)))))


CELLS = 1 << 20  # of a table that is filled cell by cell


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance: short pairs by a table in the JVM, long ones with a column of it in the bits of an integer."""
    short = F.length(a).cast("bigint") * F.length(b) <= CELLS
    return F.when(short, F.levenshtein(F.when(short, a), F.when(short, b))).otherwise(kernels.distances(F.when(~short, a), F.when(~short, b)))


def within_rate(pairs: DataFrame, reference: str, hypothesis: str, max_cer: float) -> DataFrame:
    """``pass``: whether the character error rate of normalised texts is at most ``max_cer``. Only the band of the table that this takes is filled."""
    df = (pairs.withColumn("reference_normalized", normalized_text(F.col(reference)))
          .withColumn("hypothesis_normalized", normalized_text(F.col(hypothesis))))
    n = F.greatest(F.length("reference_normalized"), F.lit(1))
    df = df.withColumn("_most", F.floor(n * max_cer + 1e-9).cast("int"))
    found = F.expr("levenshtein(reference_normalized, hypothesis_normalized, _most)")
    df = df.withColumn("_found", found).withColumn("distance", F.when(F.col("_found") >= 0, F.col("_found")))
    return (df.withColumn("cer", F.col("distance") / n).withColumn("pass", F.when(F.col("_found").isNotNull(), F.coalesce(F.col("cer") <= max_cer, F.lit(False))))
            .drop("_most", "_found"))


def edit_ops(compared: DataFrame) -> DataFrame:
    """Insertions, deletions and substitutions of one optimal alignment; ties go to substitutions."""
    ops = kernels.edit_operations(F.col("reference_normalized"), F.col("hypothesis_normalized"))
    return compared.withColumn("_ops", ops).select(*compared.columns, "_ops.*")


def speed(chars: Column, duration: Column) -> Column:
    return chars / F.greatest(duration, F.lit(0.001))


def speed_reasons(chars: Column, duration: Column, rules: QualityRules = QualityRules()) -> Column:
    rate = speed(chars, duration)
    return F.array_compact(F.array(
        F.when(duration < rules.min_duration, "too_short"),
        F.when(rate > rules.max_chars_per_second, "possible_missing_text_or_too_short"),
        F.when((chars > 5) & (rate < rules.min_chars_per_second), "possible_repetition_or_too_long")))


def level(db: float) -> float:
    return 10 ** (db / 20)


def usable(samples: Column) -> Column:
    """At least one sample, all of them finite; null for a null clip."""
    return measures(samples)["usable"]


def measures(samples: Column, rate: Column | None = None, channels: Column | None = None, clipped: float = fixed.CLIPPED_LEVEL, **levels: float) -> Column:
    """The struct ``samples.MEASURES``, taken in one pass over flat samples; see ``samples.Levels``."""
    return sm.measures(samples, sm.Levels(clipped, **levels), rate, channels)


def peak(samples: Column) -> Column:
    return measures(samples)["peak"]


def clipping_ratio(samples: Column, threshold: float = fixed.CLIPPED_LEVEL) -> Column:
    return measures(samples, clipped=threshold)["clipped"]


def mono(samples: Column, channels: Column) -> Column:
    """Channel mean of interleaved samples; empty without a positive number of channels."""
    return sm.mono(samples, channels.cast("bigint"))


def frame_rms(samples: Column, size: Column) -> Column:
    """Root mean square of each full frame; a trailing partial frame is dropped."""
    return sm.frame_rms(samples, size.cast("bigint"))


def frame_size(rate: Column, seconds: float = fixed.FRAME_SECONDS) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.bround(rate * seconds).cast("bigint"))


def longest_silence(frames: DataFrame, keys: list[str], order: list[str], silent: Column,
                    seconds: float = fixed.FRAME_SECONDS, rules: QualityRules = QualityRules(), **scan) -> DataFrame:
    """Longest silent stretch per key over a long table of frames, whatever the size of a key's group."""
    runs = longest_runs(frames, keys, order, silent, **scan)
    longest = runs.groupBy(*keys).agg(F.max("run_length").alias("_n"))
    return (frames.select(*keys).distinct().join(longest, keys, "left")
            .withColumn("longest_run", F.coalesce("_n", F.lit(0)))
            .withColumn("max_silence_seconds", F.col("longest_run") * seconds)
            .withColumn("long_silence", F.col("max_silence_seconds") > rules.max_silence_seconds).drop("_n"))


def check_clips(clips: DataFrame, samples: str = "samples", rate: str = "rate", channels: str = "channels",
                chars: str = "chars", rules: QualityRules = QualityRules()) -> DataFrame:
    """All acoustic measures and ordered reasons for clips held as sample arrays; empty or broken clips fail at once."""
    quiet = level(rules.silence_db)
    found = measures(F.col(samples), F.col(rate), F.col(channels), quiet=quiet, frame=fixed.FRAME_SECONDS)
    df = clips.withColumn("_m", found)
    ok = F.coalesce(F.col("_m.usable"), F.lit(False)) & F.col("_m.seconds").isNotNull()
    df = (df.withColumn("_ok", ok)
          .withColumns({name: F.when(F.col("_ok"), F.col(f"_m.{field}")) for name, field in
                        (("duration", "seconds"), ("peak", "peak"), ("clipping_ratio", "clipped"))})
          .withColumn("max_silence_seconds", F.when(F.col("_ok"), F.col("_m.quiet_run") * fixed.FRAME_SECONDS)))
    found = F.concat(speed_reasons(F.col(chars), F.col("duration"), rules), F.array_compact(F.array(
        F.when(F.col("peak") < quiet, "silent_audio"),
        F.when(F.col("clipping_ratio") > rules.max_clipping_ratio, "excessive_clipping"),
        F.when(F.col("max_silence_seconds") > rules.max_silence_seconds, "long_silence"))))
    reasons = F.when(F.col("_ok"), found).otherwise(F.array(F.lit("empty_or_nonfinite_audio")))
    return (df.withColumn("chars_per_second", speed(F.col(chars), F.col("duration")))
            .withColumn("reasons", reasons).withColumn("pass", F.size("reasons") == 0).drop("_ok", "_m"))


def verdict(df: DataFrame, reasons: str = "reasons", cer: str = "cer", rules: QualityRules = QualityRules()) -> DataFrame:
    """Pass without reasons; the error rate is judged only where the acoustic rules passed."""
    judged = (F.size(reasons) == 0) & (F.col(cer) > rules.max_cer)
    return (df.withColumn(reasons, F.when(judged, F.array(F.lit("asr_cer_exceeded"))).otherwise(F.col(reasons)))
            .withColumn("pass", F.size(reasons) == 0))
