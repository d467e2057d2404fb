"""Text cleaning. Every rule maps one text to one text inside its row and appends what it removed to ``audit``.

No rule explodes lines into rows, so a cleaning job is a single narrow stage from scan to sink.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, kernels
from ..functions import text as tx
from ..functions.identity import digest_string, digest_value
from ..functions.rows import unnest
from ..session import stable
from ..settings import check_patterns

AUDIT = (
    "array<struct<operation:string,n:bigint,removed:array<string>,removed_sha256:string,"
    "preview_truncated:boolean,extra:map<string,string>>>"
)


@dataclass(frozen=True)
class CleanRules:
    """Opt-in rules; the format rules always run and header removal runs unless switched off."""

    strip_source_header: bool = True
    remove_urls: bool = False
    line_patterns: list[str] = field(default_factory=list)
    strip_front_matter: bool = False
    chapter_pattern: str = fixed.CHAPTER_PATTERN
    join_wrapped_lines: bool = False


def record(operation: str, n: Column | None = None, removed: Column | None = None, sha: Column | None = None,
           truncated: Column | None = None, extra: Column | None = None) -> Column:
    def typed(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        F.lit(operation).alias("operation"), typed(n, "bigint").alias("n"),
        typed(removed, "array<string>").alias("removed"), typed(sha, "string").alias("removed_sha256"),
        typed(truncated, "boolean").alias("preview_truncated"),
        typed(extra, "map<string,string>").alias("extra"),
    )


def log(condition: Column, entry: Column) -> Column:
    """The audit array with ``entry`` appended where ``condition`` holds."""
    added = F.when(condition, F.array(entry)).otherwise(F.array().cast(AUDIT))
    return F.concat(F.col("audit"), added.cast(AUDIT))


def with_audit(df: DataFrame) -> DataFrame:
    return df if "audit" in df.columns else df.withColumn("audit", F.array().cast(AUDIT))


# Code points that NFC leaves alone whatever stands next to them: the text never has to leave the JVM for these.
_COMPOSED = (r"\x00-\u02ff\u2010-\u2027\u2030-\u205e\u3000-"
             r"\u3029\u3030-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef")


def unescape_and_compose(value: Column) -> Column:
    """Character references decoded and NFC applied; only rows that can change are sent to Python."""
    # The single-range test is fast and clears most rows; the exact one is only asked where it fails.
    affected = value.contains("&") | (value.rlike(r"[^\x00-\u02ff]") & value.rlike(f"[^{_COMPOSED}]"))
    return F.coalesce(kernels.unescape_compose(F.when(affected, value)), value)


def normalized_text(value: Column) -> Column:
    """NFKC letters and digits in lower case; ASCII rows take the JVM path."""
    wide = value.rlike(r"[^\x00-\x7f]")
    return F.coalesce(kernels.fold_compatible(F.when(wide, value)), tx.normalized_ascii(value))


def strip_html_if_tagged(df: DataFrame, text: str = "text") -> DataFrame:
    df = with_audit(df).withColumn("_tagged", F.col(text).rlike(fixed.TAGGED))
    plain = unescape_and_compose(F.when(F.col("_tagged"), tx.html_to_text(F.col(text))))
    return (df.withColumn("audit", log(F.col("_tagged"), record("strip_html")))
              .withColumn(text, F.coalesce(plain, F.col(text))).drop("_tagged"))


def normalize_unicode(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.unix_newlines(unescape_and_compose(F.col(text))))


def remove_controls(df: DataFrame, text: str = "text") -> DataFrame:
    df = with_audit(df).withColumn("_kept", tx.drop_controls(F.col(text)))
    gone = F.length(text) - F.length("_kept")
    return df.withColumn("audit", log(gone > 0, record("remove_controls", gone))).withColumn(text, F.col("_kept")).drop("_kept")


def tidy_layout(df: DataFrame, text: str = "text") -> DataFrame:
    """Runs of blanks, line edges and runs of empty lines."""
    return df.withColumn(text, tx.collapse_blank_lines(tx.trim_lines(tx.canonical_spaces(F.col(text)))))


_FIELD = rf"(?iu)^({'|'.join(fixed.HEADER_FIELDS)})\s*[:：]\s*(.*)$"
_BODY = rf"(?iu)^(?:{'|'.join(fixed.BODY_MARKERS)})\s*[:：]\s*(.*)$"


def _line_class(line: Column) -> Column:
    """One letter per line: Start marker, End marker, Field, Blank, body marker (X) or Prose."""
    mark = F.lower(F.regexp_extract(tx.strip(line), "(?i)" + fixed.HEADER_MARKER, 1))
    return (F.when(mark == "start", "S").when(mark == "end", "E").when(line.rlike(_FIELD), "F")
             .when(tx.strip(line) == "", "B").when(line.rlike(_BODY), "X").otherwise("P"))


def _site_header(lines: Column) -> Column:
    """Enough leading fields, naming title and author, one of them linking to the known site."""
    def test(opening: Column) -> Column:
        stop = F.array_position(F.transform(opening, lambda line: line.rlike(_FIELD)), False)
        prefix = F.when(stop == 0, opening).otherwise(F.slice(opening, F.lit(1), (F.greatest(stop, F.lit(1)) - 1).cast("int")))

        def judge(fields: Column) -> Column:
            def named(names: list[str]) -> Column:
                return F.exists(fields, lambda line: F.lower(F.regexp_extract(line, _FIELD, 1)).isin(names))
            return ((F.size(fields) >= fixed.HEADER_MIN_FIELDS) & named(fixed.TITLE_FIELDS) & named(fixed.AUTHOR_FIELDS)
                    & F.exists(fields, lambda line: line.rlike(fixed.HEADER_SITE)))
        return tx.let(prefix, judge)
    opening = F.filter(F.slice(lines, 1, fixed.HEADER_WINDOW), lambda line: tx.strip(line) != "")
    return tx.let(opening, test)


def _header_actions(classes: Column) -> Column:
    """One letter per class letter: (k)eep, (r)emove, keep only the (b)ody remainder.

    A header runs from a start through fields and blanks, and may end in a body marker; an end marker counts only
    after some start.
    """
    first = F.locate("S", classes)
    before = F.when(first == 0, classes).otherwise(F.substring(classes, F.lit(1), first - 1))
    after = F.when(first == 0, F.lit("")).otherwise(F.substring(classes, first, F.length(classes)))
    tokens = F.regexp_extract_all(after, F.lit("(S[FB]*X?|[^S])"), F.lit(1))
    acted = F.transform(tokens, lambda t: F.when(t.startswith("S"), F.translate(t, "SFBX", "rrrb"))
                        .otherwise(F.translate(t, "PFBXE", "kkkkr")))
    return F.concat(F.regexp_replace(before, ".", "k"), F.array_join(acted, ""))


def strip_source_header(df: DataFrame, text: str = "text") -> DataFrame:
    """Remove recognised download headers; ``extra`` of the audit record holds their title and author."""
    df = with_audit(df)
    candidate = F.col(text).rlike(r"(?i)<={3,}\s*Shaft\s+Novel\s+Start") | F.col(text).rlike(fixed.HEADER_SITE)
    lines = F.when(candidate, tx.lines(text))

    def classified(ls: Column) -> Column:
        def under(site: Column) -> Column:
            # a site header is a start that stands before the first line
            classes = F.concat(F.when(site, "S").otherwise(""), F.array_join(F.transform(ls, _line_class), ""))
            return tx.let(tx.let(classes, _header_actions), lambda acts: F.split(
                F.substring(acts, F.when(site, 2).otherwise(1), F.length(acts)), ""))
        return tx.let(_site_header(ls), under)

    df = df.withColumn("_lines", lines).withColumn("_marked", tx.let(F.col("_lines"), lambda ls: F.zip_with(
        ls, classified(ls), lambda line, act: F.struct(line.alias("line"), act.alias("act")))))

    def rest(m: Column) -> Column:
        return F.regexp_extract(m["line"], _BODY, 1)

    kept = F.transform(
        F.filter("_marked", lambda m: (m["act"] == "k") | ((m["act"] == "b") & (tx.strip(rest(m)) != ""))),
        lambda m: F.when(m["act"] == "b", rest(m)).otherwise(m["line"]))
    removed = F.transform(
        F.filter("_marked", lambda m: m["act"] != "k"),
        lambda m: F.when(m["act"] == "b", F.substring(m["line"], F.lit(1), F.length(m["line"]) - F.length(rest(m))))
                   .otherwise(m["line"]))
    fields = F.transform(F.filter("_marked", lambda m: (m["act"] == "r") & m["line"].rlike(_FIELD)), lambda m: m["line"])
    df = (df.withColumn("_kept", tx.strip(tx.unlines(kept)))
            .withColumn("_hit", F.coalesce(F.exists("_marked", lambda m: m["act"] != "k"), F.lit(False)))
            .withColumn("_gone", tx.strip(tx.unlines(removed))).withColumn("_fields", fields))

    def value_of(names: list[str]) -> Column:
        first = F.get(F.filter("_fields", lambda f: F.lower(F.regexp_extract(f, _FIELD, 1)).isin(names)), F.lit(0))
        return F.left(tx.strip(F.regexp_extract(first, _FIELD, 2)), F.lit(fixed.PREVIEW_CHARS))

    metadata = F.map_filter(
        F.create_map(F.lit("title"), value_of(fixed.TITLE_FIELDS), F.lit("author"), value_of(fixed.AUTHOR_FIELDS)),
        lambda _, v: v.isNotNull())
    entry = record("strip_downloader_metadata", F.length("_gone"), F.array(F.left("_gone", F.lit(fixed.PREVIEW_BLOCK))),
                   digest_string(F.col("_gone")), F.length("_gone") > fixed.PREVIEW_BLOCK, metadata)
    return (df.withColumn("audit", log(F.col("_hit"), entry))
              .withColumn(text, F.when(F.col("_hit"), F.col("_kept")).otherwise(F.col(text)))
              .drop("_lines", "_marked", "_kept", "_hit", "_gone", "_fields"))


def header_metadata(df: DataFrame, stem: Column) -> DataFrame:
    """Title and author: from a removed header, else the file stem and an empty author."""
    header = F.get(F.filter("audit", lambda a: a["operation"] == "strip_downloader_metadata"), F.lit(0))["extra"]
    title = F.element_at(header, "title")
    return (df.withColumn("title", F.when(title != "", title).otherwise(stem))
              .withColumn("author", F.coalesce(F.element_at(header, "author"), F.lit(""))))


_OPEN, _CLOSE = "\x01", "\x02"  # control characters are gone by the time links are unwrapped


def unwrap_markdown_links(value: Column) -> Column:
    """A link becomes its label; a label that is itself a URL goes too."""
    marked = F.regexp_replace(value, fixed.MARKDOWN_LINK, f"{_OPEN}$1{_CLOSE}")
    url_labels = F.regexp_replace(marked, rf"{_OPEN}(?U)\s*(?-U){fixed.URL_OPEN}(?U)\s*{_CLOSE}", "")
    return F.replace(F.replace(url_labels, F.lit(_OPEN), F.lit("")), F.lit(_CLOSE), F.lit(""))


def link_urls(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(fixed.MARKDOWN_LINK), F.lit(2))


def remove_inline_urls(value: Column) -> Column:
    return F.regexp_replace(value, fixed.URL, "")


def inline_urls(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(fixed.URL), F.lit(0))


def is_domain_line(line: Column) -> Column:
    """Labels, port and path are tested apart: no pattern here repeats a group, which would nest as deep as the line is long.

    Each part is taken out of the line once, and only of a line with a dot and without a blank, which most lines of prose are not.
    """
    def judge(bare: Column) -> Column:
        return tx.let(F.regexp_extract(bare, "^[^/:]*", 0), lambda host: tx.let(F.split(host, r"\.", -1), lambda labels: known(bare, host, labels)))

    def known(bare: Column, host: Column, labels: Column) -> Column:
        proper = F.forall(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x.rlike(r"\A[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\z"))
        rest = F.substring(bare, F.length(host) + 1, F.length(bare))
        return (F.size(labels) > 1) & F.element_at(labels, -1).isin(*fixed.DOMAIN_SUFFIXES) & proper & rest.rlike(r"\A(?::\d+)?(?:/[a-z0-9._~:/?#\[\]@!$&()*+,;=%-]*)?\z")

    return tx.let(tx.strip(line), lambda bare: bare.contains(".") & ~bare.contains(" ") & tx.let(F.lower(bare), judge))


def url_audit(urls: Column) -> Column:
    """Bounded preview, total count and a digest over all removed URLs."""
    long = F.exists(urls, lambda u: F.length(u) > fixed.PREVIEW_CHARS)
    return record(
        "remove_urls", F.size(urls),
        F.transform(F.slice(urls, 1, fixed.PREVIEW_ITEMS), lambda u: F.left(u, F.lit(fixed.PREVIEW_CHARS))),
        digest_value(urls), (F.size(urls) > fixed.PREVIEW_ITEMS) | long)


def remove_urls(df: DataFrame, text: str = "text") -> DataFrame:
    """Links, then inline URLs, then lines that are nothing but a domain."""
    df = (with_audit(df)
          .withColumn("_links", link_urls(F.col(text))).withColumn(text, unwrap_markdown_links(F.col(text)))
          .withColumn("_urls", inline_urls(F.col(text))).withColumn(text, remove_inline_urls(F.col(text)))
          .withColumn("_lines", tx.lines(text))
          .withColumn("_all", F.concat("_links", "_urls", F.filter("_lines", is_domain_line))))
    return (df.withColumn(text, tx.unlines(F.filter("_lines", lambda line: ~is_domain_line(line))))
              .withColumn("audit", log(F.size("_all") > 0, url_audit(F.col("_all"))))
              .drop("_links", "_urls", "_lines", "_all"))


def drop_matching_lines(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Drop lines that any pattern finds something in; the audit names the first such pattern."""
    if not patterns:
        return df

    def first_match(line: Column) -> Column:
        return F.coalesce(*[F.when(tx.search(line, p), F.lit(p)) for p in patterns])

    judged = F.transform(tx.lines(text), lambda line: F.struct(first_match(line).alias("pattern"), line.alias("text")))
    return drop_judged_lines(with_audit(df).withColumn("_judged", judged), text)


def drop_judged_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop the lines of ``_judged`` (``pattern, text``) that have a pattern."""
    df = df.withColumn("_removed", F.filter("_judged", lambda j: j["pattern"].isNotNull()))
    shown = F.transform(F.slice("_removed", 1, fixed.PREVIEW_ITEMS),
                        lambda j: F.to_json(F.struct(j["pattern"].alias("pattern"),
                                                     F.left(j["text"], F.lit(fixed.PREVIEW_CHARS)).alias("text"))))
    long = F.exists("_removed", lambda j: F.length(j["text"]) > fixed.PREVIEW_CHARS)
    entry = record("remove_user_matching_lines", F.size("_removed"), shown, digest_value(F.col("_removed")),
                   (F.size("_removed") > fixed.PREVIEW_ITEMS) | long)
    kept = F.transform(F.filter("_judged", lambda j: j["pattern"].isNull()), lambda j: j["text"])
    return (df.withColumn(text, tx.unlines(kept)).withColumn("audit", log(F.size("_removed") > 0, entry))
              .drop("_judged", "_removed"))


def strip_front_matter(df: DataFrame, pattern: str = fixed.CHAPTER_PATTERN, text: str = "text") -> DataFrame:
    """Drop everything above the first heading, if there is one and it is not already first."""
    df = (with_audit(df).withColumn("_lines", tx.lines(text))
          .withColumn("_first", F.array_position(F.transform("_lines", lambda line: tx.is_heading(line, pattern)), True)))
    cut = F.col("_first") > 1
    split_at = F.greatest(F.col("_first"), F.lit(1)).cast("int")
    df = df.withColumn("_gone", F.when(cut, tx.strip(tx.unlines(F.slice("_lines", F.lit(1), split_at - 1)))))
    entry = record("strip_front_matter", F.length("_gone"), F.array(F.left("_gone", F.lit(fixed.PREVIEW_BLOCK))),
                   digest_string(F.col("_gone")), F.length("_gone") > fixed.PREVIEW_BLOCK,
                   F.create_map(F.lit("first_chapter"), F.get("_lines", split_at - 1)))
    rest = tx.unlines(F.slice("_lines", split_at, F.size("_lines")))
    return (df.withColumn("audit", log(cut & (F.col("_gone") != ""), entry))
              .withColumn(text, F.when(cut, rest).otherwise(F.col(text))).drop("_lines", "_first", "_gone"))


def join_wrapped_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return (with_audit(df).withColumn(text, F.regexp_replace(text, fixed.WRAPPED_BREAK, ""))
            .withColumn("audit", log(F.lit(True), record("join_wrapped_lines"))))


def clean(df: DataFrame, rules: CleanRules = CleanRules(), text: str = "text") -> DataFrame:
    """All rules in their fixed order, closed by a before/after record where anything changed. Invalid patterns fail here, on the driver."""
    check_patterns(df.sparkSession, [*rules.line_patterns, rules.chapter_pattern])
    df = with_audit(df).withColumn("_original", F.col(text))
    df = strip_html_if_tagged(df, text)
    df = normalize_unicode(df, text)
    df = remove_controls(df, text)
    df = tidy_layout(df, text)
    if rules.strip_source_header:
        df = strip_source_header(df, text)
    if rules.remove_urls:
        df = remove_urls(df, text)
    df = drop_matching_lines(df, rules.line_patterns, text)
    if rules.strip_front_matter:
        df = strip_front_matter(df, rules.chapter_pattern, text)
    if rules.join_wrapped_lines:
        df = join_wrapped_lines(df, text)
    return cleanup_delta(df, text).withColumn(text, tx.strip(text)).drop("_original")


def cleanup_delta(df: DataFrame, text: str = "text", original: str = "_original") -> DataFrame:
    entry = record("format_cleanup", extra=F.create_map(
        F.lit("before_chars"), F.length(original).cast("string"), F.lit("after_chars"), F.length(text).cast("string")))
    return with_audit(df).withColumn("audit", log(F.col(original) != F.col(text), entry))


def audit_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per audit record, numbered within its document."""
    return unnest(df, "audit", *keys, at="seq", value="entry").select(*keys, "seq", "entry.*")


def audit_union(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def audit_preview(rows: DataFrame, book: str, order: list[str]) -> DataFrame:
    """At most 100 bounded records per book beside the full count.

    The records are written once: totals and ranks do not clean the texts again. Ranks are of the keys alone, and only the records that
    have one of the first meet their previews again: what a task reads of a book does not grow with the number of tasks that hold its records. The
    rank filter becomes a partial limit before the shuffle; the count is a partial aggregate.
    """
    rows = stable(rows.withColumn("_row", F.monotonically_increasing_id()))
    totals = rows.groupBy(book).agg(F.count("*").alias("audit_count"))
    keys = list(dict.fromkeys([book, *order]))
    ranked = rows.select(*keys, "_row").withColumn("position", F.row_number().over(Window.partitionBy(book).orderBy(*order)))
    first = stable(ranked.filter(F.col("position") <= fixed.PREVIEW_ITEMS).select("_row", "position"))
    bounded = (rows.join(first, "_row").drop("_row")
               .withColumn("removed", F.transform(F.slice("removed", 1, fixed.PREVIEW_LIST),
                                                  lambda v: F.left(v, F.lit(fixed.PREVIEW_CHARS)))))
    return (bounded.join(totals, book)
            .withColumn("audit_truncated", F.col("audit_count") > fixed.PREVIEW_ITEMS))


def removal_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Records and removed counts per cleanup operation."""
    return rows.groupBy(*keys, "operation").agg(F.count("*").alias("records"),
                                                F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))
