"""Reading order and sections of parsed EPUB tables.

Inputs: ``spine(book_id,pos,item,linear)``, ``docs(book_id,item,name,properties,html)``, ``toc(book_id,pos,href,title)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rows import keep_where, unnest
from ..session import stable
from . import chapters as ch
from .clean import CleanRules, clean, unescape_and_compose, record
from .scan import position, running

_MARK, _END, _CUT = "\x01", "\x02", "\x03"


def spine_order(spine: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents at their first spine position, and the repeated spine entries for the audit.

    The first position is a partial aggregate, so one item repeated through most of the spine costs no more than one row
    per task.
    """
    first = spine.groupBy("book_id", "item").agg(F.min_by("linear", "pos").alias("linear"), F.min("pos").alias("pos"))
    ordered = first.join(docs, ["book_id", "item"])
    names = docs.select("book_id", "item", "name")
    repeated = (spine.join(first.select("book_id", "item", F.col("pos").alias("_first")), ["book_id", "item"])
                .filter(F.col("pos") > F.col("_first")).join(names, ["book_id", "item"])
                .select("book_id", "pos", F.col("name").alias("source"), F.lit("skip_repeated_spine_item").alias("operation")))
    return ordered, repeated


def split_navigation(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    nav = ch.is_navigation(F.col("name"), F.col("properties"), F.col("linear"))
    skipped = ordered.filter(nav).select("book_id", "pos", F.col("name").alias("source"),
                                         F.lit("skip_navigation_or_non_linear").alias("operation"))
    return ordered.filter(~nav), skipped


_ID = r"""(?i)(<[a-z][^>]*?\sid\s*=\s*["']([^"'>]+)["'][^>]*>)"""


def anchor_titles(docs: DataFrame, toc: DataFrame, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document the existing anchors with their first titles, and the missing ones (of the documents in ``read``).

    Only ids leave the document row; at most one array entry per id of the document comes back.
    """
    wanted = (toc.filter(F.instr("href", "#") > 0)
              .select("book_id", F.substring_index("href", "#", 1).alias("name"),
                      F.substring_index("href", "#", -1).alias("anchor"), "pos", "title")
              .filter(F.col("anchor") != "")
              .groupBy("book_id", "name", "anchor").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos")))
    present = unnest(docs, F.array_distinct(F.regexp_extract_all("html", F.lit(_ID), F.lit(2))), "book_id", "name", value="anchor").drop("_at")
    known = (docs if read is None else read).select("book_id", "name")
    missing = wanted.join(known, ["book_id", "name"]).join(present, ["book_id", "name", "anchor"], "left_anti").select(
        "book_id", F.col("name").alias("source"), F.lit("missing_toc_anchor").alias("operation"), "anchor")
    found = wanted.join(present, ["book_id", "name", "anchor"])
    grouped = found.groupBy("book_id", "name").agg(F.collect_list(F.struct("anchor", "title")).alias("anchors"))
    return grouped.filter(F.size("anchors") >= 2), missing


def section_array(html: Column, anchors: Column, title: Column) -> Column:
    """Sections of one document: the preamble under the document's title, then one per anchor, in document order."""
    marked = F.regexp_replace(html, _ID, f"\n{_MARK}$2{_END}\n$1")
    pieces = F.split(tx.html_to_text(marked), _MARK, -1)

    def titled(parts: Column) -> Column:
        names = F.transform(parts, lambda p, i: F.when(i > 0, F.substring_index(p, _END, 1)))
        titles = F.map_from_entries(anchors)

        def rebuild(ids: Column) -> Column:
            def piece(p: Column, i: Column) -> Column:
                anchor = F.substring_index(p, _END, 1)
                body = F.substring(p, F.length(anchor) + 2, F.length(p))
                opens = F.map_contains_key(titles, anchor) & (F.array_position(ids, anchor) == i + 1)
                return F.when(i == 0, p).when(opens, F.concat(F.lit(_CUT), p)).otherwise(body)
            return F.split(F.array_join(F.transform(parts, piece), ""), _CUT, -1)

        return F.transform(tx.let(names, rebuild), lambda s, i: F.struct(
            F.when(i == 0, title).otherwise(F.element_at(titles, F.substring_index(s, _END, 1))).alias("title"),
            F.when(i == 0, s).otherwise(F.substring(s, F.instr(s, _END) + 1, F.length(s))).alias("text")))

    return tx.let(pieces, titled)


def split_by_anchor(docs: DataFrame, toc: DataFrame, rules: CleanRules = CleanRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned readable sections of documents with two or more anchors, the remaining documents, and missing anchors."""
    anchors, missing = anchor_titles(docs, toc)
    joined = docs.join(anchors, ["book_id", "name"], "left")
    plain = joined.filter(F.col("anchors").isNull()).drop("anchors")
    kept = [c for c in docs.columns if c not in {"html", "title"}]
    sections = unnest(joined.filter(F.col("anchors").isNotNull()), section_array(F.col("html"), F.col("anchors"), F.col("title")),
                      *kept, at="section", value="_s").select(*kept, "section", "_s.title", "_s.text")
    return keep_where(clean(sections, rules), tx.readable("text")), plain, missing


def split_notes(sections: DataFrame, text: str = "text") -> DataFrame:
    """An audit row for each document that was split at anchors, with the number of its readable sections: ``book_id, pos, source, operation, detail``."""
    counted = sections.groupBy("book_id", "pos", F.col("name").alias("source")).agg(F.count_if(tx.readable(text)).alias("_n"))
    return counted.select("book_id", "pos", "source", F.lit("split_toc_anchors").alias("operation"), record("split_toc_anchors", F.col("_n")).alias("detail"))


def assemble(spine: DataFrame, docs: DataFrame, toc: DataFrame, rules: CleanRules = CleanRules()) -> tuple[DataFrame, DataFrame]:
    """Chapters in reading order (``book_id, chapter_index, title, text, source``) and the audit of every decision.

    Order, navigation, titles and anchors are settled on narrow tables; the markup joins once, at the end.
    """
    ordered, repeated = spine_order(spine, docs.drop("html"))
    reading, navigation = split_navigation(ordered)
    anchors, missing = anchor_titles(docs, toc, reading)
    keys = ["book_id", "name"]
    settled = reading.join(ch.toc_titles(toc), keys, "left").join(anchors, keys, "left")
    full = settled.join(docs.select("book_id", "item", "html"), ["book_id", "item"])
    full = full.withColumn("title", F.coalesce(unescape_and_compose(ch.first_heading(F.col("html"))), "toc_title"))
    whole_text = F.array(F.struct("title", tx.html_to_text(F.col("html")).alias("text")))
    pieces = F.when(F.col("anchors").isNotNull(), section_array(F.col("html"), F.col("anchors"), F.col("title"))).otherwise(whole_text)
    kept = ["book_id", "pos", "name", F.col("anchors").isNotNull().alias("anchored"), ch.lacks_paragraphs(F.col("html")).alias("flagged")]
    rows = unnest(full, pieces, *kept, at="section", value="_s").select(
        "book_id", "pos", "name", "anchored", "flagged", "section", "_s.title", unescape_and_compose(F.col("_s.text")).alias("text"))
    rows = rows.withColumn("empty", ~F.col("anchored") & ~tx.readable("text"))
    # Parsing is the costly part and feeds the counts, the chapters and the audit, so it is written once.
    written = stable(clean(rows, rules))
    parsed = written.filter(~F.col("empty"))
    split_docs = ~F.col("anchored")
    parsed = parsed.withColumn("_trimmed", F.when(F.col("anchored"), F.col("text")).otherwise(
        ch.drop_duplicate_title_lines(F.col("text"), F.coalesce("title", F.lit("")))))
    split = ch.drop_title_only_first(ch.chapter_array(F.col("_trimmed"), F.col("title"), rules.chapter_pattern), F.col("title"))
    whole = F.array(F.struct("title", F.col("_trimmed").alias("text")))
    parsed = parsed.withColumn("_chapters", F.when(F.col("anchored"), whole).otherwise(split))

    # An untitled document is named after the number of chapters before it.
    per_doc = parsed.groupBy("book_id", "pos").agg(F.sum(F.size("_chapters")).alias("_n"))
    before = running(per_doc, ["book_id"], ["pos"], {"_upto": F.col("_n")}).select(
        "book_id", "pos", (F.col("_upto") - F.col("_n") + 1).alias("_next"))
    parts = (unnest(parsed, "_chapters", "book_id", "pos", "name", "section", value="_c")
             .join(before, ["book_id", "pos"])
             .select("book_id", "pos", "name", "section", "_at", F.col("_c.text").alias("text"),
                     F.coalesce("_c.title", F.concat(F.lit("Chapter "), F.col("_next").cast("string"))).alias("title")))
    place = ["book_id", "pos", "section", "_at"]
    readable = ch.keep_readable(parts)
    numbered = readable.join(position(readable.select(*place), ["book_id"], ["pos", "section", "_at"], "chapter_index"), place)

    def note(rows: DataFrame, operation: str) -> DataFrame:
        return rows.select("book_id", "pos", F.col("name").alias("source"), F.lit(operation).alias("operation"))

    cleaned = (unnest(parsed, "audit", "book_id", "pos", F.col("name").alias("source"), at="_i", value="_a")
               .select("book_id", "pos", "source", F.col("_a.operation").alias("operation"), F.col("_a").alias("detail")))
    audit = repeated
    for extra in (navigation, note(written.filter("empty"), "skip_image_only_or_empty"),
                  note(parsed.filter(F.length("_trimmed") < F.length("text")), "remove_adjacent_duplicate_title"),
                  note(parsed.filter(split_docs & F.col("flagged")), "review_non_paragraph_document"), missing, split_notes(written.filter("anchored")), cleaned):
        audit = audit.unionByName(extra, allowMissingColumns=True)
    return numbered.select("book_id", F.col("chapter_index").cast("int").alias("chapter_index"), "title", "text",
                           F.col("name").alias("source")), audit
