"""Chapters: splitting one text is row-local; numbering chapters of a book uses the skew-safe scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.rows import unnest
from ..settings import check_patterns
from .scan import position

_BREAK = "\x01\x02\x01"


def chapter_array(text: Column, title: Column, pattern: str = fixed.CHAPTER_PATTERN) -> Column:
    """``array<struct<title,text>>``: a new chapter opens at each heading; text above the first belongs to the title."""
    marked = tx.unlines(F.transform(
        tx.lines(text), lambda line: F.when(tx.is_heading(line, pattern), F.concat(F.lit(_BREAK), tx.strip(line))).otherwise(line)))
    chunks = F.transform(
        F.split(marked, f"\n?{_BREAK}", -1),
        lambda chunk, i: F.struct(F.when(i == 0, title).otherwise(F.substring_index(chunk, "\n", 1)).alias("title"),
                                  tx.strip(chunk).alias("text")))
    return F.filter(chunks, lambda c: c["text"] != "")


def split_chapters(df: DataFrame, title: Column, pattern: str = fixed.CHAPTER_PATTERN, text: str = "text") -> DataFrame:
    """One row per chapter, with ``chapter_index`` dense within the row's document and ``title``/``text`` replaced."""
    keep = [c for c in df.columns if c not in {text, "title", "chapter_index"}]
    exploded = unnest(df, chapter_array(F.col(text), title, pattern), *keep, value="_chapter")
    return exploded.select(*keep, (F.col("_at") + 1).alias("chapter_index"), F.col("_chapter.title").alias("title"),
                           F.col("_chapter.text").alias(text))


def first_heading(html: Column) -> Column:
    """Text of the first h1–h3; each text piece is trimmed. Null without a heading."""
    inner = F.regexp_extract(html, r"(?is)<(h[1-3])(?:\s[^>]*)?>(.*?)</\1\s*>", 2)
    pieces = F.transform(F.split(inner, r"<[^>]*>"), tx.strip)
    return F.when(html.rlike(r"(?is)<(h[1-3])(?:\s[^>]*)?>.*?</\1\s*>"), F.array_join(pieces, ""))


def toc_titles(toc: DataFrame) -> DataFrame:
    """The first table-of-contents title per document: ``book_id, name, toc_title``."""
    target = F.substring_index("href", "#", 1)
    return toc.groupBy("book_id", target.alias("name")).agg(F.min_by("title", "pos").alias("toc_title"))


def is_navigation(name: Column, properties: Column, linear: Column) -> Column:
    return (F.coalesce(F.array_contains(F.split(properties, r"\s+"), "nav"), F.lit(False))
            | name.rlike(fixed.NAVIGATION_NAME) | F.coalesce(linear == "no", F.lit(False)))


def drop_duplicate_title_lines(text: Column, title: Column) -> Column:
    """While the first two lines both repeat the title, drop the first. What is left keeps its line breaks as they are."""
    def run_of(ls: Column, name: Column) -> Column:
        # stripping is the costly part, and most lines do not hold the title
        same = F.transform(ls, lambda line: (line.contains(name) & (tx.strip(line) == name)).eqNullSafe(F.lit(True)))
        return tx.let(F.array_position(same, False), lambda other: F.greatest(F.when(other == 0, F.size(ls)).otherwise(other - 1).cast("int"), F.lit(1)))

    def keep_last(whole: Column, ls: Column, run: Column) -> Column:
        # a break is one character, but for the pair that counts as one
        paired = F.array_join(F.slice(F.split(whole, fixed.AFTER_BREAKS, -1), run, F.size(ls) + 1), "")
        dropped = tx.unlines(F.slice(ls, F.lit(1), run - 1))
        rest = F.when(whole.contains("\r\n"), paired).otherwise(F.substring(whole, F.length(dropped) + 2, F.length(whole)))
        return F.when(run > 1, rest).otherwise(whole)

    return tx.let(title, lambda name: tx.let(text, lambda whole: tx.let(tx.lines(whole), lambda ls: tx.let(run_of(ls, name), lambda run: keep_last(whole, ls, run)))))


def drop_title_only_first(chapters: Column, title: Column) -> Column:
    """An opening chapter that is only the title, when others follow."""
    alone = (F.size(chapters) > 1) & (F.get(chapters, F.lit(0))["text"] == title)
    return F.when(alone, F.slice(chapters, F.lit(2), F.greatest(F.size(chapters), F.lit(1)))).otherwise(chapters)


def lacks_paragraphs(html: Column) -> Column:
    return ~html.rlike(r"(?i)<p(?:\s[^>]*)?/?>")


def exclude_chapters(chapters: DataFrame, patterns: list[str], title: str = "title") -> tuple[DataFrame, DataFrame]:
    """Chapters to keep, and the excluded ones for the audit. A pattern that is none is an error. For patterns that are data see ``rules``."""
    check_patterns(chapters.sparkSession, patterns)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | tx.search(F.col(title), pattern)
    return chapters.filter(~hit), chapters.filter(hit)


def keep_readable(chapters: DataFrame, text: str = "text") -> DataFrame:
    return chapters.filter(tx.readable(text))


def books_without_chapters(books: DataFrame, chapters: DataFrame, book: str = "book_id") -> DataFrame:
    return (books.join(chapters.select(book).distinct(), book, "left_anti")
            .withColumn("error", F.lit("No readable chapters")))


def number_chapters(chapters: DataFrame, book: str, order: list[str], **scan) -> DataFrame:
    """Dense 1-based chapter numbers per book after filtering."""
    return position(chapters, [book], order, "chapter_index", **scan)


# ---- chapter selections ------------------------------------------------------------------------------------------

def selection_ranges(spec: Column, limit: int = 1_000_000) -> Column:
    """``"1,3-5"`` as ``array<struct<lo,hi>>``; null when any part is malformed, descending, zero or above ``limit``."""
    parts = F.transform(F.split(spec, ",", -1), lambda p: tx.strip(p))
    shaped = F.forall(parts, lambda p: p.rlike(r"\A\d{1,9}\s*(?:-\s*\d{1,9})?\z"))

    def bounds(p: Column) -> Column:
        edge = F.split(p, "-", -1)
        return F.struct(tx.strip(F.element_at(edge, 1)).try_cast("bigint").alias("lo"),
                        tx.strip(F.element_at(edge, -1)).try_cast("bigint").alias("hi"))

    ranges = F.transform(parts, bounds)
    sound = F.forall(ranges, lambda r: (r["lo"] >= 1) & (r["hi"] >= r["lo"]) & (r["hi"] <= limit))
    return F.when(shaped & sound, ranges)


def parse_selection(df: DataFrame, spec: str, *keys: str, limit: int = 1_000_000) -> DataFrame:
    """One row per selected chapter number."""
    ranges = unnest(df, selection_ranges(F.col(spec), limit), *keys, value="_r")
    return unnest(ranges, F.sequence("_r.lo", "_r.hi"), *keys, value="chapter_index").select(*keys, "chapter_index").distinct()


def select_chapters(chapters: DataFrame, ranges: Column, index: str = "chapter_index") -> DataFrame:
    """Keep the chapters inside the ranges, with their original numbers; no expansion and no join."""
    return chapters.filter(F.exists(ranges, lambda r: F.col(index).between(r["lo"], r["hi"])))


def selection_scope(df: DataFrame, selected: str, total: str) -> DataFrame:
    whole = F.col(selected) == F.col(total)
    return df.withColumn("complete_book", whole).withColumn(
        "export_scope", F.when(whole, "complete_book").otherwise("selected_chapters"))


def invalid_selection(books: DataFrame, ranges: Column, total: str, *keys: str) -> DataFrame:
    """Requested numbers beyond the book's last chapter; only the overhang is expanded."""
    over = unnest(books, ranges, *keys, F.col(total).alias("_n"), value="_r").filter(F.col("_r.hi") > F.col("_n"))
    start = F.greatest(F.col("_r.lo"), F.col("_n") + 1)
    return unnest(over, F.sequence(start, F.col("_r.hi")), *keys, value="invalid_index").select(*keys, "invalid_index").distinct()


def selection_errors(books: DataFrame, spec: str, total: str, *keys: str) -> DataFrame:
    """Why a book's selection cannot be used: ``keys, error``. No row for a usable one."""
    ranges = selection_ranges(F.col(spec))
    blank = F.coalesce(tx.strip(F.col(spec)), F.lit("")) == ""
    reached = F.exists(ranges, lambda r: r["lo"] <= F.col(total))
    error = F.when(blank, "nothing selected").when(ranges.isNull(), "malformed").when(~reached, "no such chapter")
    return books.select(*keys, error.alias("error")).filter(F.col("error").isNotNull())


def pick_cover(items: DataFrame) -> DataFrame:
    """The declared cover image, else the first image whose properties or name say cover."""
    says_cover = F.array_contains(F.split(F.coalesce("properties", F.lit("")), r"\s+"), "cover-image") | F.lower("name").contains("cover")
    rank = F.when(F.col("item") == F.col("cover_item"), 0).when(says_cover, 1)
    return (items.filter(F.col("media_type").startswith("image/")).withColumn("_rank", rank)
            .filter(F.col("_rank").isNotNull()).groupBy("book_id")
            .agg(F.min_by(F.col("name"), F.struct("_rank", "pos")).alias("cover_name")))


def cover_images(items: DataFrame) -> DataFrame:
    """The picked cover of each book with its bytes: ``book_id, cover_name, media_type, data``. Covers are picked without the bytes; those of the
    picked ones alone are joined back, by their place in the book."""
    narrow = items.drop("data")
    picked = pick_cover(narrow)
    same = [items["book_id"] == F.col("_book"), items["name"] == F.col("cover_name")]
    found = items.filter(items["media_type"].startswith("image/")).join(picked.withColumnRenamed("book_id", "_book"), same)
    return found.groupBy("book_id", "cover_name").agg(F.min_by(F.struct("media_type", "data"), "pos").alias("_c")).select("book_id", "cover_name", "_c.*")
