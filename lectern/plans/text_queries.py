"""Cleaning queries (T-*, SRC-4)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, kernels
from ..functions import text as tx
from ..functions.rows import unnest
from ..operators import clean as cl
from ..operators import rules
from .inputs import (SENTENCE_LINE, documents, pages, sql_html, sql_lines, sql_references, sql_strip, sql_tidy, table)
from .registry import query

_TAGGED = fixed.TAGGED


@query("src4_html_to_text", f"SELECT page_id, {sql_references(sql_html('html'))} AS text FROM pages")
def src4_html_to_text(spark, d):
    return pages(spark, d).select("page_id", cl.unescape_and_compose(tx.html_to_text(F.col("html"))).alias("text"))


@query("src4_html_to_text_strict", f"SELECT page_id, regexp_replace({sql_references(sql_html('html'))}, '\\s+', '', 'g') AS letters FROM pages")
def src4_html_to_text_strict(spark, d):
    text = pages(spark, d).select("page_id", kernels.html_text_strict(F.col("html")).alias("t"))
    return text.select("page_id", F.regexp_replace("t", r"\s+", "").alias("letters"))


@query("t1_strip_html_if_tagged", f"""
WITH mixed AS (SELECT page_id AS id, html AS text FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents)
SELECT id, CASE WHEN regexp_matches(text, '{_TAGGED}') THEN {sql_references(sql_html('text'))} ELSE text END AS text,
  CASE WHEN regexp_matches(text, '{_TAGGED}') THEN 1 ELSE 0 END::BIGINT AS records FROM mixed""")
def t1_strip_html_if_tagged(spark, d):
    mixed = pages(spark, d).select(F.col("page_id").alias("id"), F.col("html").alias("text")).unionByName(
        documents(spark, d).select((-1 - F.col("doc_id")).alias("id"), "text"))
    return cl.strip_html_if_tagged(mixed).select("id", "text", F.size("audit").cast("bigint").alias("records"))


@query("t2_normalize_unicode", f"SELECT page_id, {sql_references('html')} AS text FROM pages")
def t2_normalize_unicode(spark, d):
    dos = pages(spark, d).select("page_id", F.replace("html", F.lit("\n"), F.lit("\r\n")).alias("text"))
    return cl.normalize_unicode(dos)


@query("t2_compose", "SELECT doc_id, nfc_normalize(strip_accents(text) || text) AS text FROM documents")
def t2_compose(spark, d):
    """Decomposed accents come back composed; the plain letters in front stay."""
    bare = F.translate("text", "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ", "eoencueaoßiEENOCAEUOI")
    apart = F.col("text")
    for char in "éóèñçüêäöíÉÈÑÓÇÄÊÜÖÍ":
        apart = F.replace(apart, F.lit(char), F.lit(unicodedata.normalize("NFD", char)))
    return documents(spark, d).select("doc_id", cl.unescape_and_compose(F.concat(bare, apart)).alias("text"))


@query("t3_canonical_spaces", """
SELECT doc_id, regexp_replace(translate(replace(text, ' ', ' ' || chr(9) || chr(160)), chr(160) || chr(12288), '  '), '[ \\t]+', ' ', 'g') AS text
FROM documents""")
def t3_canonical_spaces(spark, d):
    wide = F.replace("text", F.lit(" "), F.lit(" \t\u00a0"))
    return documents(spark, d).select("doc_id", tx.canonical_spaces(wide).alias("text"))


@query("t4_remove_controls", r"""
WITH noisy AS (SELECT doc_id, replace(text, ',', chr(8203) || ',' || chr(7) || chr(65279)) AS t FROM documents),
kept AS (SELECT doc_id, t, regexp_replace(t, '[\x00-\x08\x0b-\x1f\x7f-\x9f]|\p{Cf}|\p{Cs}', '', 'g') AS text FROM noisy)
SELECT doc_id, text, nullif(length(t) - length(text), 0)::BIGINT AS removed FROM kept""")
def t4_remove_controls(spark, d):
    noisy = documents(spark, d).withColumn("text", F.replace("text", F.lit(","), F.lit("\u200b,\x07\ufeff")))
    return cl.remove_controls(noisy).select("doc_id", "text", F.get("audit", F.lit(0))["n"].alias("removed"))


_RAGGED = "replace(text, chr(10), ' ' || chr(9) || chr(10) || chr(12288) || ' ')"


@query("t5_trim_lines", f"""
SELECT doc_id, array_to_string(list_transform({sql_lines('t')}, lambda x: {sql_strip('x')}), chr(10)) AS text
FROM (SELECT doc_id, {_RAGGED} AS t FROM documents)""")
def t5_trim_lines(spark, d):
    ragged = F.replace("text", F.lit("\n"), F.lit(" \t\n\u3000 "))
    return documents(spark, d).select("doc_id", tx.trim_lines(ragged).alias("text"))


@query("t6_collapse_blank_lines", f"""
SELECT doc_id, {sql_strip("regexp_replace(replace(text, '. ', '.' || repeat(chr(10), 4)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text
FROM documents""")
def t6_collapse_blank_lines(spark, d):
    gaps = F.replace("text", F.lit(". "), F.lit(".\n\n\n\n"))
    return documents(spark, d).select("doc_id", tx.collapse_blank_lines(gaps).alias("text"))


def with_headers(spark, d) -> DataFrame:
    """English: marked block after an opening line; French: site header; others: fields without a site, which stay."""
    head = F.concat(F.lit("Title: Doc "), F.col("doc_id").cast("string"), F.lit("\nAuthor: "), F.col("source"), F.lit("\n\nTags: x\n"))
    marked = F.concat(F.lit("Opening line\n<=== Shaft Novel Start ===>\n"), head, F.lit("Body: "), F.col("text"), F.lit("\n<===Shaft Novel End===>"))
    site = F.concat(head, F.lit("小说链接：https://www.pixiv.net/novel/"), F.col("doc_id").cast("string"), F.lit("\n正文：\n"), F.col("text"))
    text = F.when(F.col("lang") == "en", marked).when(F.col("lang") == "fr", site).otherwise(F.concat(head, F.col("text")))
    return documents(spark, d).withColumn("text", text)


_HEAD = "'Title: Doc ' || doc_id || chr(10) || 'Author: ' || source || chr(10) || chr(10) || 'Tags: x' || chr(10)"


@query("t7_strip_source_header", f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {sql_strip("'Opening line' || chr(10) || text")} WHEN lang = 'fr' THEN {sql_strip('text')}
  ELSE {_HEAD} || text END AS text, (lang IN ('en', 'fr')) AS recognized FROM documents""")
def t7_strip_source_header(spark, d):
    return cl.strip_source_header(with_headers(spark, d)).select("doc_id", "text", (F.size("audit") > 0).alias("recognized"))


@query("t7b_header_metadata", """
SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'Doc ' || doc_id ELSE 'stem' || doc_id END AS title,
  CASE WHEN lang IN ('en', 'fr') THEN source ELSE '' END AS author FROM documents""")
def t7b_header_metadata(spark, d):
    stem = F.concat(F.lit("stem"), F.col("doc_id").cast("string"))
    return cl.header_metadata(cl.strip_source_header(with_headers(spark, d)), stem).select("doc_id", "title", "author")


def with_links(spark, d) -> DataFrame:
    host = F.concat(F.lit("http://h"), F.col("doc_id").cast("string"), F.lit(".example.com/p?q=1"))
    text = F.replace("text", F.lit(", "), F.concat(F.lit(", [a label]("), host, F.lit(") ")))
    text = F.replace(text, F.lit(". "), F.concat(F.lit(". [ www.site.example.org ](  "), host, F.lit(") and "), host, F.lit("). ")))
    text = F.replace(text, F.lit("\n"), F.concat(F.lit("\nsite"), F.col("doc_id").cast("string"), F.lit(".example.net/x\n")))
    return documents(spark, d).withColumn("text", text)


@query("t8_unwrap_markdown_links", """
SELECT doc_id, replace(replace(replace(text, ', ', ', a label '), '. ', '.  and http://h' || doc_id || '.example.com/p?q=1). '),
  chr(10), chr(10) || 'site' || doc_id || '.example.net/x' || chr(10)) AS text FROM documents""")
def t8_unwrap_markdown_links(spark, d):
    return with_links(spark, d).select("doc_id", cl.unwrap_markdown_links(F.col("text")).alias("text"))


@query("t9_remove_inline_urls", """
SELECT page_id, regexp_replace('Visit ' || url || ', or (' || url || ')!', '(?i)(?:https?://|www\\.)[a-z0-9](?:[a-z0-9._~:/?#\\[\\]@!$&()*+,;=%-]*[a-z0-9_~:/#\\[\\]@$&(*+=%-])?', '', 'g') AS text,
  2::BIGINT AS urls FROM pages""")
def t9_remove_inline_urls(spark, d):
    text = F.concat(F.lit("Visit "), F.col("url"), F.lit(", or ("), F.col("url"), F.lit(")!"))
    return pages(spark, d).select("page_id", cl.remove_inline_urls(text).alias("text"),
                                  F.size(cl.inline_urls(text)).cast("bigint").alias("urls"))


@query("t10_drop_domain_lines", f"""
WITH t AS (SELECT doc_id, {sql_lines("replace(text, chr(10), chr(10) || 'site' || doc_id || '.example.net/x' || chr(10))")} AS ls FROM documents)
SELECT doc_id, array_to_string(list_filter(ls, lambda x: x NOT LIKE 'site%.example.net/x'), chr(10)) AS text FROM t""")
def t10_drop_domain_lines(spark, d):
    host = F.concat(F.lit("\nsite"), F.col("doc_id").cast("string"), F.lit(".example.net/x\n"))
    lines = tx.lines(F.replace("text", F.lit("\n"), host))
    return documents(spark, d).select("doc_id", tx.unlines(F.filter(lines, lambda x: ~cl.is_domain_line(x))).alias("text"))


@query("t11_url_audit", f"""
WITH n AS (
  SELECT doc_id, (length(text) - length(replace(text, ', ', ''))) // 2 AS commas, (length(text) - length(replace(text, '. ', ''))) // 2 AS stops,
    length(text) - length(replace(text, chr(10), '')) AS breaks, regexp_extract_all(text, ', |\\. ') AS seps, text FROM documents),
u AS (
  SELECT doc_id, list_concat(
    list_transform(seps, lambda x: 'http://h' || doc_id || '.example.com/p?q=1'),
    list_transform(range(0, stops), lambda x: 'http://h' || doc_id || '.example.com/p?q=1'),
    list_transform(range(0, breaks), lambda x: 'site' || doc_id || '.example.net/x')) AS urls FROM n)
SELECT doc_id, len(urls)::BIGINT AS n, sha256(to_json(urls)::VARCHAR) AS removed_sha256, len(urls) > 100 AS preview_truncated,
  array_to_string(list_slice(urls, 1, 100), ' ') AS preview FROM u WHERE len(urls) > 0""")
def t11_url_audit(spark, d):
    rows = cl.audit_rows(cl.remove_urls(with_links(spark, d)), "doc_id")
    return rows.select("doc_id", "n", "removed_sha256", "preview_truncated", F.array_join("removed", " ").alias("preview"))


LINE_PATTERNS = [r"(?i)licen[sc]e", r"(?i)copyright", r"token = ", r"[0-9]{3}\.[0-9]"]
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{p}'" for p in LINE_PATTERNS) + " END"


@query("t12_drop_matching_lines", f"""
WITH j AS (SELECT doc_id, list_transform({sql_lines('text')}, lambda x: {{'pattern': {_FIRST}, 'text': x}}) AS ls FROM documents),
r AS (SELECT doc_id, list_filter(ls, lambda x: x.pattern IS NOT NULL) AS gone, list_filter(ls, lambda x: x.pattern IS NULL) AS kept FROM j)
SELECT doc_id, array_to_string(list_transform(kept, lambda x: x.text), chr(10)) AS text, nullif(len(gone), 0)::BIGINT AS removed,
  CASE WHEN len(gone) > 0 THEN sha256(to_json(gone)::VARCHAR) END AS removed_sha256 FROM r""")
def t12_drop_matching_lines(spark, d):
    df = cl.drop_matching_lines(documents(spark, d), LINE_PATTERNS)
    entry = F.get("audit", F.lit(0))
    return df.select("doc_id", "text", entry["n"].alias("removed"), entry["removed_sha256"].alias("removed_sha256"))


#: Rules by language: (language, ordinal, pattern).
LINE_RULES = [("en", 2, r"(?i)copyright"), ("en", 1, r"(?i)licen[sc]e"), ("en", 3, r"token = "), ("fr", 1, r"[0-9]{3}\.[0-9]"), ("de", 1, r"token = "), ("de", 2, r"(?i)licen[sc]e")]
_BY_LANGUAGE = "CASE " + " ".join(f"WHEN lang = '{lang}' AND regexp_matches(x, '{p}') THEN '{p}'" for lang, _, p in sorted(LINE_RULES)) + " END"


def line_rules(spark) -> DataFrame:
    return spark.createDataFrame(LINE_RULES, "scope string, ordinal int, pattern string")


@query("t12_drop_by_rules", f"""
WITH j AS (SELECT doc_id, list_transform({sql_lines('text')}, lambda x: {{'pattern': {_BY_LANGUAGE}, 'text': x}}) AS ls FROM documents),
r AS (SELECT doc_id, list_filter(ls, lambda x: x.pattern IS NOT NULL) AS gone, list_filter(ls, lambda x: x.pattern IS NULL) AS kept FROM j)
SELECT doc_id, array_to_string(list_transform(kept, lambda x: x.text), chr(10)) AS text, nullif(len(gone), 0)::BIGINT AS removed,
  CASE WHEN len(gone) > 0 THEN sha256(to_json(gone)::VARCHAR) END AS removed_sha256 FROM r""")
def t12_drop_by_rules(spark, d):
    """Patterns that are rows and differ by language."""
    df = rules.drop_matching_lines(documents(spark, d), line_rules(spark), "lang")
    entry = F.get("audit", F.lit(0))
    return df.select("doc_id", "text", entry["n"].alias("removed"), entry["removed_sha256"].alias("removed_sha256"))


@query("t12_rules_from_items", r"""
WITH k AS (SELECT 'en' AS scope, item_id AS ordinal, regexp_extract(text, '([a-zA-Z]{5,}) ', 1) AS pattern FROM benchmark),
l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT l.doc_id, l.line, (SELECT arg_min(k.pattern, k.ordinal) FROM k WHERE k.scope = l.lang AND regexp_matches(l.line, k.pattern)) AS pattern FROM l)
SELECT doc_id, count(*) AS lines, count(pattern) AS dropped, min(pattern) AS least FROM h GROUP BY doc_id""")
def t12_rules_from_items(spark, d):
    """As many rules as there are benchmark items, each a word of one; the plan is the same for any number."""
    word = F.regexp_extract("text", "([a-zA-Z]{5,}) ", 1)
    from_items = table(spark, d, "benchmark").select(F.lit("en").alias("scope"), F.col("item_id").alias("ordinal"), word.alias("pattern"))
    lines = unnest(documents(spark, d).filter(F.col("text").isNotNull()), F.split("text", "\n", -1), "doc_id", "lang", value="line")
    judged = rules.exclude_chapters(lines, from_items, "lang", "line")
    return judged.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("excluded_by").alias("dropped"), F.min("excluded_by").alias("least"))


@query("t13_strip_front_matter", f"""
WITH t AS (SELECT doc_id, text, {sql_lines('text')} AS ls FROM documents),
f AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches({sql_strip('x')}, '^[^.]{{1,58}}\\.$')), true) AS p FROM t)
SELECT doc_id, CASE WHEN p > 1 THEN array_to_string(ls[p:], chr(10)) ELSE text END AS text,
  CASE WHEN p > 1 THEN nullif(length({sql_strip("array_to_string(ls[1:p - 1], chr(10))")}), 0) END::BIGINT AS removed FROM f""")
def t13_strip_front_matter(spark, d):
    df = cl.strip_front_matter(documents(spark, d), SENTENCE_LINE)
    return df.select("doc_id", "text", F.get("audit", F.lit(0))["n"].alias("removed"))


@query("t14_join_wrapped_lines", """
WITH t AS (SELECT doc_id, string_split(replace(text, '. ', '!' || chr(10)), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM t),
w AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM l)
SELECT doc_id, string_agg(x || CASE WHEN i = n THEN '' WHEN regexp_matches(x, '[。！？!?…]$') OR (nx = '' AND i + 1 < n) THEN chr(10) ELSE '' END, '' ORDER BY i) AS text
FROM w GROUP BY doc_id""")
def t14_join_wrapped_lines(spark, d):
    df = documents(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit("!\n")))
    return cl.join_wrapped_lines(df).select("doc_id", "text")


def padded(spark, d) -> DataFrame:
    return documents(spark, d).withColumn("text", F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n\n \n\n")), F.lit("\n")))


_PADDED = "'  ' || replace(text, chr(10), chr(10) || chr(10) || ' ' || chr(10) || chr(10)) || chr(10)"


@query("t15_clean_documents", f"""
WITH p AS (SELECT doc_id, {_PADDED} AS raw FROM documents), c AS (SELECT doc_id, raw, {sql_tidy('raw')} AS text FROM p)
SELECT doc_id, text, length(raw)::VARCHAR AS before_chars, length(text)::VARCHAR AS after_chars FROM c""")
def t15_clean_documents(spark, d):
    """The whole default rule chain with its before/after record."""
    df = cl.clean(padded(spark, d))
    extra = F.element_at("audit", -1)["extra"]
    return df.select("doc_id", "text", extra["before_chars"].alias("before_chars"), extra["after_chars"].alias("after_chars"))


@query("t15_clean_pages", f"SELECT page_id, {sql_tidy(sql_references(sql_references(sql_html('html'))))} AS text FROM pages")
def t15_clean_pages(spark, d):
    return cl.clean(pages(spark, d).select("page_id", F.col("html").alias("text"))).select("page_id", "text")


def _audits(spark, d) -> DataFrame:
    lines = cl.audit_rows(cl.drop_matching_lines(documents(spark, d), LINE_PATTERNS), "source", "doc_id")
    front = cl.audit_rows(cl.strip_front_matter(documents(spark, d), SENTENCE_LINE), "source", "doc_id")
    html = cl.audit_rows(cl.strip_html_if_tagged(pages(spark, d).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))), "source", "doc_id")
    return cl.audit_union(lines, front, html)


_AUDITS = f"""
j AS (SELECT doc_id, source, {sql_lines('text')} AS ls FROM documents),
g AS (SELECT doc_id, source, list_filter(ls, lambda x: {_FIRST} IS NOT NULL) AS gone,
  list_position(list_transform(ls, lambda x: regexp_matches({sql_strip('x')}, '^[^.]{{1,58}}\\.$')), true) AS p, ls FROM j),
a AS (
  SELECT source, doc_id, 'remove_user_matching_lines' AS operation, len(gone)::BIGINT AS n FROM g WHERE len(gone) > 0
  UNION ALL SELECT source, doc_id, 'strip_front_matter', length({sql_strip("array_to_string(ls[1:p - 1], chr(10))")}) FROM g
    WHERE p > 1 AND {sql_strip("array_to_string(ls[1:p - 1], chr(10))")} <> ''
  UNION ALL SELECT 'pages', page_id, 'strip_html', NULL FROM pages)"""


@query("t16_audit_union", f"WITH {_AUDITS} SELECT source, operation, count(*) AS records, coalesce(sum(n), 0)::BIGINT AS removed FROM a GROUP BY ALL")
def t16_audit_union(spark, d):
    return cl.removal_totals(_audits(spark, d), "source")


@query("t17_audit_preview", f"""
WITH {_AUDITS},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, operation) AS position, count(*) OVER (PARTITION BY source) AS audit_count FROM a)
SELECT source, doc_id, operation, n, position::BIGINT AS position, audit_count, audit_count > 100 AS audit_truncated FROM r WHERE position <= 100""")
def t17_audit_preview(spark, d):
    rows = cl.audit_preview(_audits(spark, d), "source", ["doc_id", "operation"])
    return rows.select("source", "doc_id", "operation", "n", F.col("position").cast("bigint").alias("position"), "audit_count", "audit_truncated")


@query("t18_normalized_text", "SELECT doc_id, lower(regexp_replace(nfc_normalize(text), '[^\\p{L}\\p{N}]', '', 'g')) AS text FROM documents")
def t18_normalized_text(spark, d):
    return documents(spark, d).select("doc_id", cl.normalized_text(F.col("text")).alias("text"))
