"""Spoken text: literal replacements applied once, longest first, inside the row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rows import unnest


def _literal(term: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#\-])", r"\\\1", term)


def check_terms(terms: dict[str, str]) -> None:
    for source, spoken in terms.items():
        if not source.strip() or not spoken.strip():
            raise ValueError("Replacements need a non-blank source and spoken form")
        if len(source) > fixed.TERM_LIMIT or len(spoken) > fixed.REPLACEMENT_LIMIT:
            raise ValueError("Replacements must stay short")


def terms_pattern(terms: dict[str, str]) -> str:
    return "|".join(_literal(t) for t in sorted(terms, key=len, reverse=True))


def replace_terms(value: Column, terms: dict[str, str]) -> Column:
    """Every term replaced in one pass, so a replacement is never replaced again."""
    if not terms:
        return value
    check_terms(terms)
    if len(terms) == 1:
        (source, spoken), = terms.items()
        return F.replace(value, F.lit(source), F.lit(spoken))
    pattern = terms_pattern(terms)
    spoken = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    # the text between terms and the terms themselves, put together again in turn
    between = F.split(value, pattern, -1)
    said = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda t: spoken[t])
    return F.array_join(F.zip_with(between, F.concat(said, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def spoken_text(df: DataFrame, terms: dict[str, str], text: str = "text") -> DataFrame:
    """Add ``spoken_text``, and ``error`` where a changed piece grew past the limit; the source text stays."""
    spoken = replace_terms(F.col(text), terms)
    df = df.withColumn("spoken_text", spoken)
    grown = (F.col("spoken_text") != F.col(text)) & (F.length("spoken_text") > fixed.SPOKEN_LIMIT)
    return df.withColumn("error", F.when(grown, f"Replacements expanded a segment beyond {fixed.SPOKEN_LIMIT} characters"))


def replacement_counts(df: DataFrame, terms: dict[str, str], *keys: str, text: str = "text") -> DataFrame:
    """How often each present term was replaced, per key."""
    found = F.regexp_extract_all(F.col(text), F.lit(terms_pattern(terms)), F.lit(0))
    return (unnest(df, found, *keys, value="source").groupBy(*keys, "source")
            .agg(F.count("*").alias("count")))


def replacement_audit(df: DataFrame, terms: dict[str, str], *keys: str, text: str = "text") -> DataFrame:
    """An audit row for each segment that terms changed: ``keys, operation, replacements``, a map from term to count."""
    changed = df.filter(replace_terms(F.col(text), terms) != F.col(text))
    counted = replacement_counts(changed, terms, *keys, text=text).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source", "count"))).alias("_all"))
    return counted.select(*keys, F.lit("pronunciation_replacements").alias("operation"), F.map_from_entries("_all").alias("replacements"))


def preview_text(chapters: DataFrame, book: str, index: str = "chapter_index", text: str = "text",
                 limit: int = fixed.PREVIEW_TEXT) -> DataFrame:
    """The first ``limit`` characters of a book, whatever numbers its chapters have.

    Chapters are joined by two characters, so those that come after ``limit / 2`` others cannot reach into the preview, and none
    contributes more than ``limit`` characters: what a task gathers per book is bounded. The rank filter runs before the shuffle too.
    """
    rank = F.row_number().over(Window.partitionBy(book).orderBy(index))
    near = chapters.select(book, index, F.left(text, F.lit(limit)).alias("_t")).withColumn("_r", rank).filter(F.col("_r") <= limit // 2 + 1)
    joined = near.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(index, "_t"))).alias("_all"))
    return joined.select(book, F.left(F.array_join(F.transform("_all", lambda c: c["_t"]), "\n\n"), F.lit(limit)).alias("preview"))
