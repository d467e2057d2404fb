"""Column expressions over text. All stay in the JVM and work inside one row, so none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column | str) -> Column:
    return F.btrim(col(value), F.lit(fixed.WHITESPACE))


def lines(value: Column | str) -> Column:
    """Split at every line separator; a trailing separator opens no extra line and empty text has no lines."""
    def parts(text: Column) -> Column:
        # nearly all texts have line feeds alone, and at a single character Java splits without a pattern
        other = text.rlike(fixed.RARE_BREAKS)
        for char in fixed.WIDE_BREAKS:
            other = other | text.contains(char)
        return F.when(other, F.split(text, fixed.LINE_BREAKS, -1)).otherwise(F.split(text, "\n", -1))

    return let(
        let(col(value), parts),
        lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, 1, F.size(ls) - 1)).otherwise(ls),
    )


def unlines(value: Column) -> Column:
    return F.array_join(value, "\n")


def full_match(value: Column, pattern: str, ignore_case: bool = True) -> Column:
    flags = "(?iuU)" if ignore_case else "(?U)"
    return value.rlike(rf"{flags}\A(?:{pattern})\z")


def search(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?U){pattern}")


def is_heading(line: Column, pattern: str) -> Column:
    """A heading is a short line that the pattern covers completely once trimmed."""
    trimmed = strip(line)
    return (F.length(trimmed) <= fixed.HEADING_LIMIT) & full_match(trimmed, pattern)


def readable(value: Column | str) -> Column:
    """At least one letter or digit."""
    return col(value).rlike(r"[\p{L}\p{N}]")


def canonical_spaces(value: Column) -> Column:
    return F.regexp_replace(value, r"[ \t\u00a0\u3000]+", " ")


def drop_controls(value: Column) -> Column:
    return F.regexp_replace(value, r"[\p{Cc}\p{Cf}\p{Cs}&&[^\n\t]]", "")


def trim_lines(value: Column) -> Column:
    return unlines(F.transform(lines(value), strip))


def collapse_blank_lines(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"\n{3,}", "\n\n"))


def unix_newlines(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\n?", "\n")


def html_to_text(markup: Column) -> Column:
    """Pattern-based text extraction: hidden elements go, block tags and ``br`` break lines, inline tags vanish.

    Character references are left in place; see ``clean.unescape_and_compose``.
    """
    hidden = "|".join(fixed.DROPPED_ELEMENTS)
    blocks = "|".join(fixed.BLOCK_ELEMENTS)
    text = F.regexp_replace(markup, r"(?s)<\?xml[^>]*\?>|<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?is)<({hidden})(?:\s[^>]*)?>.*?</\1\s*>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{blocks}|br)(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")


def normalized_ascii(value: Column) -> Column:
    """Letters and digits only, lower case; exact for ASCII input."""
    return F.lower(F.regexp_replace(value, r"[^0-9A-Za-z]", ""))


def safe_name(value: Column, limit: int = 60) -> Column:
    """A portable file stem: reserved characters, device names, edge dots and blanks are neutralised."""
    name = F.left(F.btrim(F.regexp_replace(value, fixed.RESERVED_CHARACTERS, "_"), F.lit(" .")), F.lit(limit))
    guarded = F.when(name.rlike(fixed.DEVICE_NAMES), F.concat(F.lit("_"), name)).otherwise(name)
    return F.when(guarded == "", F.lit(fixed.FALLBACK_NAME)).otherwise(guarded)


def clock(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; a dash for missing, negative or non-finite values."""
    whole = F.floor(seconds).cast("bigint")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    def two(value: Column) -> Column:
        return F.lpad(value.cast("bigint").cast("string"), 2, "0")
    long = F.concat(hours.cast("bigint").cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))
    short = F.concat(minutes.cast("bigint").cast("string"), F.lit(":"), two(rest))
    missing = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    return F.when(missing, F.lit("—")).when(hours > 0, long).otherwise(short)
