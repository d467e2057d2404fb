"""Operator settings: closed, range-checked dataclasses validated on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed


def _within(name: str, value: float, low: float | None = None, high: float | None = None, above: float | None = None) -> None:
    if (low is not None and value < low) or (high is not None and value > high) or (above is not None and value <= above):
        raise ValueError(f"{name}={value} is out of range")


@dataclass(frozen=True)
class SegmentSizes:
    target: int = fixed.TARGET_CHARS
    longest: int = fixed.MAX_CHARS
    shortest: int = fixed.MIN_CHARS

    def __post_init__(self):
        _within("target", self.target, 20, 800)
        _within("longest", self.longest, 40, 1000)
        _within("shortest", self.shortest, 1)
        if not self.shortest <= self.target <= self.longest:
            raise ValueError("Expected shortest <= target <= longest")


@dataclass(frozen=True)
class QualityRules:
    max_retry: int = fixed.MAX_RETRY
    min_duration: float = fixed.MIN_DURATION
    min_chars_per_second: float = fixed.MIN_CHARS_PER_SECOND
    max_chars_per_second: float = fixed.MAX_CHARS_PER_SECOND
    max_silence_seconds: float = fixed.MAX_SILENCE_SECONDS
    silence_db: float = fixed.SILENCE_DB
    max_clipping_ratio: float = fixed.MAX_CLIPPING_RATIO
    max_cer: float = fixed.MAX_CER

    def __post_init__(self):
        _within("max_retry", self.max_retry, 0, 20)
        for name in ("min_duration", "min_chars_per_second", "max_chars_per_second", "max_silence_seconds"):
            _within(name, getattr(self, name), above=0)
        _within("silence_db", self.silence_db, -90, -10)
        _within("max_clipping_ratio", self.max_clipping_ratio, 0, 1)
        _within("max_cer", self.max_cer, 0, 1)


@dataclass(frozen=True)
class DeliverySettings:
    sentence_pause: float = fixed.PAUSES["sentence"]
    paragraph_pause: float = fixed.PAUSES["paragraph"]
    clause_pause: float = fixed.PAUSES["clause"]
    chapter_pause: float = fixed.PAUSES["chapter"]
    speech_rate: float = 1.0

    def __post_init__(self):
        _within("sentence_pause", self.sentence_pause, 0, 3)
        _within("paragraph_pause", self.paragraph_pause, 0, 5)
        _within("clause_pause", self.clause_pause, 0, 2)
        _within("chapter_pause", self.chapter_pause, 0, 5)
        _within("speech_rate", self.speech_rate, 0.75, 1.5)

    @property
    def pauses(self) -> dict[str, float]:
        return {"paragraph": self.paragraph_pause, "sentence": self.sentence_pause, "clause": self.clause_pause,
                "hard": self.clause_pause, "chapter": self.chapter_pause}


def load(kind, values: dict):
    """Settings from a dictionary; unknown keys are rejected."""
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"Unknown settings: {sorted(unknown)}")
    return kind(**values)


def check_patterns(spark: SparkSession, patterns: list[str]) -> None:
    """Fail on the driver if a pattern is no valid regular expression of the engine that will run it."""
    if patterns:
        compiled = [F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(patterns)]
        for pattern, found in zip(patterns, spark.range(1).select(*compiled).first(), strict=True):
            if found is None:
                raise ValueError(f"Invalid regular expression: {pattern}")
