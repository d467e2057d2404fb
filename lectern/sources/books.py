"""From files to books and numbered chapters, for text and EPUB together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chapters as ch
from ..operators import clean as cl
from ..operators import epub
from ..session import stable
from . import readers


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*\z", "")


def parse_books(files: DataFrame, rules: cl.CleanRules = cl.CleanRules(), exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """``books, chapters, audit, errors`` of discovered files (``path, content``); a book is known by its path.

    ``books``: ``book_id, title, author``; ``chapters``: ``book_id, chapter_index, title, text, source``, without those whose title matches a
    pattern of ``exclude`` and those with nothing to read. A file that cannot be decoded or opened, and a book that is left without
    chapters, gives a row in ``errors`` and stops nothing else. Cleaned texts and containers' entries are written once.
    """
    texts, undecodable = readers.decode_text(files.filter(F.lower("path").endswith(".txt")))
    texts = texts.select(F.col("path").alias("book_id"), "text")
    texts = stable(cl.header_metadata(cl.clean(texts, rules), stem(F.col("book_id"))))
    plain = ch.split_chapters(texts.select("book_id", "title", "text"), F.col("title"), rules.chapter_pattern)
    plain = plain.select("book_id", "chapter_index", "title", "text", F.substring_index("book_id", "/", -1).alias("source"))

    found = readers.read_epub(files)
    bound, bound_audit = epub.assemble(found["spine"], found["docs"], found["toc"], rules)
    facts = found["meta"].groupBy("book_id").pivot("name", ["title", "creator"]).agg(F.min_by("value", "pos"))
    opened = found["docs"].select("book_id").distinct().join(facts, "book_id", "left")
    books = texts.select("book_id", "title", "author").unionByName(
        opened.select("book_id", F.coalesce("title", stem(F.col("book_id"))).alias("title"), F.coalesce("creator", F.lit("")).alias("author")))

    kept, dropped = ch.exclude_chapters(plain.unionByName(bound), exclude or [])
    kept = stable(ch.keep_readable(kept).withColumnRenamed("chapter_index", "_at"))
    numbers = ch.number_chapters(kept.select("book_id", "_at"), "book_id", ["_at"])
    chapters = kept.join(numbers, ["book_id", "_at"]).select("book_id", F.col("chapter_index").cast("int").alias("chapter_index"), "title", "text", "source")

    excluded = dropped.select("book_id", "source", F.lit("user_excluded_chapter").alias("operation"), F.col("title").alias("chapter"))
    audit = cl.audit_union(cl.audit_rows(texts, "book_id").select("book_id", "operation", "n", "removed"), bound_audit.select("book_id", "source", "operation"), excluded)
    errors = (undecodable.select(F.col("path").alias("book_id"), "error").unionByName(found["errors"].select("book_id", "error"))
              .unionByName(ch.books_without_chapters(books.select("book_id"), kept)))
    return {"books": books, "chapters": chapters, "audit": audit, "errors": errors}
