"""Segmentation and rewriting queries (G-*) and the flagship summary (A-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rows import unnest
from ..operators import chapters as ch
from ..operators import clean as cl
from ..operators import rewrite as rw
from ..operators import rollup
from ..operators import segment as sg
from .chapter_queries import CHAPTERS, document_chapters
from .inputs import LINES, SENTENCE_LINE, WS, conversations, document_lines, documents, sql_strip
from .registry import query

_SPACE = f"[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f]"


def sql_segments(texts: str, target: int = 200, longest: int = 300, shortest: int = 60) -> str:
    """Exact segmentation as recursive SQL over ``texts`` (columns ``k, text``), giving ``segs``.

    Bracket nesting is followed for round brackets and straight quotes, the only ones in the tables.
    """
    return f"""
g_text AS ({texts}),
g_char AS (SELECT k, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM g_text WHERE text <> ''),
g_flow AS (
  SELECT k, c, i, lag(c) OVER w AS pc, lead(c) OVER w AS nc, count(*) OVER (PARTITION BY k) AS n,
    sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS bal,
    sum((c = '"')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS quotes,
    sum((c = chr(10))::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS breaks,
    min(CASE WHEN position(c IN '”’」』。！？!?…' || chr(10) || ' ' || chr(9)) = 0 THEN i END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS solid
  FROM g_char WINDOW w AS (PARTITION BY k ORDER BY i)),
g_open AS (
  SELECT *, bal - least(0, min(bal) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)) = 0 AND quotes % 2 = 0 AS outside,
    coalesce(lead(solid) OVER (PARTITION BY k ORDER BY i), n) AS e FROM g_flow),
g_kind AS (
  SELECT k, i, n, nc, outside, breaks, greatest(e, i + 1) AS e,
    CASE WHEN c = chr(10) THEN 'paragraph' WHEN position(c IN '。！？!?；;…') > 0 THEN 'sentence'
      WHEN c = '.' THEN CASE WHEN pc BETWEEN '0' AND '9' AND nc BETWEEN '0' AND '9' THEN NULL ELSE 'sentence' END
      WHEN position(c IN '，,、：:') > 0 THEN 'clause'
      WHEN c IN (')', '"') AND outside AND position(coalesce(pc, 'x') IN '。！？!?…') > 0 THEN 'sentence' END AS kind
  FROM g_open),
g_ends AS (
  SELECT a.k, a.e, a.n, max_by(CASE WHEN a.e > a.i + 1 AND b.breaks > a.breaks THEN 'paragraph' ELSE a.kind END, a.i) AS kind,
    max_by(a.outside OR (a.e > a.i + 1 AND a.nc = ')'), a.i) AS outside
  FROM g_kind a JOIN g_kind b ON a.k = b.k AND b.i = a.e - 1 WHERE a.kind IS NOT NULL AND a.e < a.n GROUP BY a.k, a.e, a.n),
g_list AS (
  SELECT k, list({{'e': e, 'kind': kind, 'cost': (CASE kind WHEN 'paragraph' THEN 0 WHEN 'sentence' THEN 15 ELSE 70 END), 'inside': (NOT outside)::INT}} ORDER BY e) AS ends
  FROM g_ends GROUP BY k),
g_doc AS MATERIALIZED (SELECT t.k, t.text, length(t.text) AS n, coalesce(l.ends, []) AS ends FROM g_text t LEFT JOIN g_list l USING (k)),
g_walk AS (
  WITH RECURSIVE walk AS (
    SELECT k, 0::BIGINT AS no, 0::BIGINT AS s, 0::BIGINT AS e, '' AS kind FROM g_doc
    UNION ALL
    SELECT k, no, s, c.e, c.kind FROM (
      SELECT k, no, s, n, text, CASE WHEN s + {longest} >= n THEN {{'score': [0, 0], 'e': n, 'kind': 'chapter'}}
        WHEN len(near) > 0 THEN list_sort(list_transform(near, lambda x: {{'score': [x.inside, abs(x.e - s - {target}) + x.cost], 'e': x.e, 'kind': x.kind}}))[1]
        WHEN back BETWEEN 1 AND 29 THEN {{'score': [0, 0], 'e': s + {longest} - back + 1, 'kind': 'hard'}}
        ELSE {{'score': [0, 0], 'e': s + {longest}, 'kind': 'hard'}} END AS c
      FROM (
        SELECT k, no, s, n, text, list_filter(ends, lambda x: x.e >= s + {shortest} AND x.e <= s + {longest}) AS near,
          strpos(reverse(substr(text, s + {shortest} + 1, {longest - shortest})), ' ') AS back
        FROM (SELECT w.k, w.no + 1 AS no, d.n, d.text, d.ends,
                w.e + length(substr(d.text, w.e + 1)) - length(ltrim(substr(d.text, w.e + 1), {WS})) AS s
              FROM walk w JOIN g_doc d USING (k) WHERE w.e < d.n)
        WHERE s < n)))
  SELECT * FROM walk WHERE no > 0),
segs AS (
  SELECT w.k, w.no AS seg_index, {sql_strip('substr(d.text, w.s + 1, w.e - w.s)')} AS text, w.s AS start_at, w.e AS end_at, w.kind AS boundary
  FROM g_walk w JOIN g_doc d USING (k))
"""


DOC_SEGMENTS = sql_segments("SELECT doc_id AS k, text FROM documents")
_UNMARKED = "translate(text, '.,!', '___')"


def bigints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def exact(df: DataFrame, *keys: str, **sizes) -> DataFrame:
    rows = sg.segment_exact(df, *keys, **sizes)
    return bigints(rows.withColumnRenamed("start", "start_at").withColumnRenamed("end", "end_at"), "seg_index", "start_at", "end_at")


@query("g2_segment_exact", f"WITH {DOC_SEGMENTS} SELECT k AS doc_id, seg_index, text, start_at, end_at, boundary FROM segs")
def g2_segment_exact(spark, d):
    return exact(documents(spark, d), "doc_id")


@query("g2_segment_exact_small", f"WITH {sql_segments('SELECT doc_id AS k, text FROM documents', 100, 180, 30)} SELECT k AS doc_id, seg_index, text, boundary FROM segs")
def g2_segment_exact_small(spark, d):
    return exact(documents(spark, d), "doc_id", target=100, longest=180, shortest=30).select("doc_id", "seg_index", "text", "boundary")


def sql_light(texts: str) -> str:
    """The light segmentation as a walk over the positions of its marks, giving ``segs`` for ``texts`` (``k, text``)."""
    return f"""
l_text AS ({texts}),
l_char AS (SELECT k, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM l_text WHERE text <> ''),
l_next AS (SELECT k, c, i, lead(c) OVER (PARTITION BY k ORDER BY i) AS nc FROM l_char),
l_list AS (
  SELECT k, coalesce(list(i ORDER BY i) FILTER (position(c IN '.!?。！？…' || chr(10)) > 0 AND (nc IS NULL OR position(nc IN ' ' || chr(9) || chr(10) || chr(13)) > 0)), []) AS stops,
    coalesce(list(i ORDER BY i) FILTER (position(c IN ',，、;；:：') > 0), []) AS clauses,
    coalesce(list(i ORDER BY i) FILTER (position(c IN ' ' || chr(9) || chr(10) || chr(13)) > 0), []) AS blanks FROM l_next GROUP BY k),
l_doc AS MATERIALIZED (SELECT t.k, t.text, length(t.text) AS n, l.stops, l.clauses, l.blanks FROM l_text t JOIN l_list l USING (k)),
l_walk AS (
  WITH RECURSIVE walk AS (
    SELECT k, 0::BIGINT AS no, 0::BIGINT AS s, 0::BIGINT AS e FROM l_doc
    UNION ALL
    SELECT k, no, s, CASE WHEN a IS NOT NULL THEN least(a + 2, n) WHEN c IS NOT NULL THEN c + 1 WHEN w IS NOT NULL THEN w + 1 ELSE least(s + 300, n) END FROM (
      SELECT k, no, s, n, list_max(list_filter(stops, lambda x: x > s AND x < s + 300)) AS a, list_max(list_filter(clauses, lambda x: x > s AND x < s + 300)) AS c,
        list_max(list_filter(blanks, lambda x: x > s AND x < s + 300)) AS w
      FROM (SELECT v.k, v.no + 1 AS no, d.n, d.stops, d.clauses, d.blanks,
              v.e + length(substr(d.text, v.e + 1)) - length(ltrim(substr(d.text, v.e + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS s
            FROM walk v JOIN l_doc d USING (k) WHERE v.e < d.n)
      WHERE s < n))
  SELECT * FROM walk WHERE no > 0),
segs AS (SELECT w.k, w.no AS seg_index, {sql_strip('substr(d.text, w.s + 1, w.e - w.s)')} AS text FROM l_walk w JOIN l_doc d USING (k))
"""


@query("g2_segment_light", f"WITH {sql_light('SELECT doc_id AS k, text FROM documents')} SELECT k AS doc_id, seg_index, text FROM segs")
def g2_segment_light(spark, d):
    return bigints(sg.segment_light(documents(spark, d), "doc_id"), "seg_index")


@query("g1_boundaries", f"""WITH {DOC_SEGMENTS},
f AS (SELECT k, unnest(ends) AS x FROM g_doc UNION ALL SELECT k, {{'e': n, 'kind': 'chapter', 'cost': 0, 'inside': 0}} FROM g_doc WHERE n > 0)
SELECT k AS doc_id, x.kind AS kind, count(*) AS boundaries, sum(x.e)::BIGINT AS offsets, sum(x.inside)::BIGINT AS inside FROM f GROUP BY ALL""")
def g1_boundaries(spark, d):
    """Where pieces may end: counts and offset sums per kind, and how many lie inside quotations."""
    rows = unnest(documents(spark, d), sg.boundaries(F.col("text")), "doc_id", value="x")
    return rows.groupBy("doc_id", "x.kind").agg(F.count("*").alias("boundaries"), F.sum("x.end").alias("offsets"),
                                                F.count_if(~F.col("x.outside")).alias("inside"))


@query("g3_lossless", "SELECT doc_id, 0::BIGINT AS lossy FROM documents")
def g3_lossless(spark, d):
    docs = documents(spark, d)
    cut = docs.select("doc_id", "text", sg.exact_pieces()(F.col("text")).alias("pieces"))
    return cut.select("doc_id", (~sg.is_lossless(F.col("pieces"), F.col("text"))).cast("bigint").alias("lossy"))


@query("g3_lossy_chapters", "SELECT doc_id FROM documents WHERE doc_id % 50 = 0")
def g3_lossy_chapters(spark, d):
    """Stored segments against their chapters; some chapters have lost a segment."""
    docs = documents(spark, d)
    stored = sg.segment_exact(docs, "doc_id").filter((F.col("doc_id") % 50 != 0) | (F.col("seg_index") > 1))
    return sg.lossy_chapters(stored, docs, "doc_id")


@query("g3_lossless_light", f"SELECT doc_id, regexp_replace(text, '{_SPACE}+', '', 'g') AS letters FROM documents")
def g3_lossless_light(spark, d):
    pieces = sg.light_pieces(F.col("text"))
    return documents(spark, d).select("doc_id", sg.compact(F.array_join(pieces, "")).alias("letters"))


@query("g4_slice_check", "SELECT doc_id, 0::BIGINT AS violations FROM documents")
def g4_slice_check(spark, d):
    docs = documents(spark, d)
    # the source text rides along only inside the projection that compares it
    rows = unnest(docs, sg.exact_pieces()(F.col("text")), "doc_id", F.col("text").alias("source_text"), value="p").select("doc_id", "source_text", "p.*")
    bad = sg.slice_violations(rows).groupBy("doc_id").agg(F.count("*").alias("violations"))
    return docs.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.coalesce("violations", F.lit(0)).alias("violations"))


@query("g5_flatten_segments", f"WITH {LINES}, r AS (SELECT doc_id, line_no, text, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS seg_index FROM lines) SELECT doc_id, seg_index, text FROM r")
def g5_flatten_segments(spark, d):
    pieces = F.transform(F.filter(tx.lines("text"), lambda x: tx.strip(x) != ""), lambda x: F.struct(x.alias("text")))
    return bigints(sg.flatten_segments(documents(spark, d), pieces, "doc_id"), "seg_index")


SWAP = {"der": "die", "die": "der", "the": "THE", "them": "us", "a.b(c": "x"}


@query("g6_replace_terms", """
SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'them', chr(3)), 'the', 'THE'), 'der', chr(1)), 'die', 'der'), chr(1), 'die'), chr(3), 'us') AS text FROM documents""")
def g6_replace_terms(spark, d):
    return documents(spark, d).select("doc_id", rw.replace_terms(F.col("text"), SWAP).alias("text"))


@query("g6_replace_one_term", "SELECT doc_id, replace(text, 'tion', 'sion') AS text FROM documents")
def g6_replace_one_term(spark, d):
    return documents(spark, d).select("doc_id", rw.replace_terms(F.col("text"), {"tion": "sion"}).alias("text"))


@query("g7_replacement_counts", f"""
WITH {LINES}, m AS (SELECT doc_id, line_no, replace(text, 'them', chr(3)) AS t FROM lines),
c AS (SELECT doc_id, line_no, 'them' AS source, len(t) - len(replace(t, chr(3), '')) AS n FROM m
  UNION ALL SELECT doc_id, line_no, x, (len(t) - len(replace(t, x, ''))) // 3 FROM m, (SELECT unnest(['the', 'der', 'die']) AS x))
SELECT doc_id, line_no, source, n::BIGINT AS count FROM c WHERE n > 0""")
def g7_replacement_counts(spark, d):
    return bigints(rw.replacement_counts(document_lines(spark, d), SWAP, "doc_id", "line_no"), "line_no")


@query("g7_replacement_audit", f"""
WITH {LINES}, m AS (SELECT doc_id, line_no, replace(text, 'them', chr(3)) AS t FROM lines),
c AS (SELECT doc_id, line_no, 'them' AS source, len(t) - len(replace(t, chr(3), '')) AS n FROM m
  UNION ALL SELECT doc_id, line_no, x, (len(t) - len(replace(t, x, ''))) // 3 FROM m, (SELECT unnest(['the', 'der', 'die']) AS x))
SELECT doc_id, line_no, 'pronunciation_replacements' AS operation, string_agg(source || '=' || n::BIGINT, ',' ORDER BY source) AS replacements FROM c WHERE n > 0 GROUP BY ALL""")
def g7_replacement_audit(spark, d):
    rows = rw.replacement_audit(document_lines(spark, d), SWAP, "doc_id", "line_no")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("replacements")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return bigints(rows.select("doc_id", "line_no", "operation", told.alias("replacements")), "line_no")


@query("g8_expansion_guard", f"""
WITH {LINES} SELECT doc_id, line_no, length(replace(text, 'e', 'eeeeeeeee'))::BIGINT AS spoken_chars,
  CASE WHEN contains(text, 'e') AND length(replace(text, 'e', 'eeeeeeeee')) > 1000 THEN 'Replacements expanded a segment beyond 1000 characters' END AS error FROM lines""")
def g8_expansion_guard(spark, d):
    rows = rw.spoken_text(document_lines(spark, d), {"e": "e" * 9})
    return bigints(rows.select("doc_id", "line_no", F.length("spoken_text").alias("spoken_chars"), "error"), "line_no", "spoken_chars")


@query("g9_preview_text", "SELECT conv_id, left(string_agg(text, chr(10) || chr(10) ORDER BY turn), 4000) AS preview FROM conversations GROUP BY conv_id")
def g9_preview_text(spark, d):
    turns = conversations(spark, d).withColumn("chapter_index", F.col("turn") + 1)
    return rw.preview_text(turns, "conv_id")


@query("g9_preview_late_selection", """SELECT conv_id, left(string_agg(text, chr(10) || chr(10) ORDER BY turn DESC), 4000) AS preview FROM conversations WHERE turn > 0 GROUP BY conv_id""")
def g9_preview_late_selection(spark, d):
    """Chapters keep their high numbers when the early ones were not selected."""
    turns = conversations(spark, d).filter("turn > 0").withColumn("chapter_index", 9000 - F.col("turn"))
    return rw.preview_text(turns, "conv_id")


@query("g10_hard_splits", f"""
WITH {sql_segments(f"SELECT doc_id AS k, {_UNMARKED} AS text FROM documents")}
SELECT k AS doc_id, count(*) FILTER (boundary = 'hard') AS hard_splits, count(*) AS segments FROM segs GROUP BY k""")
def g10_hard_splits(spark, d):
    """Prose without its punctuation has few places to cut."""
    bare = documents(spark, d).withColumn("text", F.translate("text", ".,!", "___"))
    return sg.hard_splits(sg.segment_exact(bare, "doc_id"), "doc_id")


def chapter_segments(spark, d) -> DataFrame:
    """Cleaned documents cut into chapters and exact segments."""
    cleaned = cl.tidy_layout(documents(spark, d))
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    chapters = ch.split_chapters(cleaned, title, SENTENCE_LINE)
    return sg.segment_exact(chapters, "doc_id", "lang", "source", "chapter_index", "title")


@query("a1_plan_summary", f"""
WITH {CHAPTERS}, {sql_segments("SELECT lang || '/' || doc_id || '/' || chapter_index AS k, text FROM chapters")}
SELECT split_part(k, '/', 1) AS lang, count(*) FILTER (seg_index = 1) AS chapters, count(*) AS segments, sum(length(text))::BIGINT AS chars,
  sum(length(text))::BIGINT AS spoken_chars, count(*) FILTER (boundary = 'hard') AS hard_splits, max(length(text))::BIGINT AS longest
FROM segs GROUP BY ALL""")
def a1_plan_summary(spark, d):
    """Flagship: clean, chapters, exact segments and a per-language summary behind one small exchange."""
    return bigints(rollup.plan_summary(chapter_segments(spark, d), "lang", chapter=["doc_id", "chapter_index"]), "longest")


@query("a1_plan_summary_light", f"""
WITH {CHAPTERS}, {sql_light("SELECT lang || '/' || doc_id || '/' || chapter_index AS k, text FROM chapters")}
SELECT split_part(k, '/', 1) AS lang, count(*) FILTER (seg_index = 1) AS chapters, count(*) AS segments, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM segs GROUP BY ALL""")
def a1_plan_summary_light(spark, d):
    """The same without leaving the JVM."""
    rows = sg.segment_light(document_chapters(spark, d), "doc_id", "lang", "chapter_index")
    return bigints(rollup.plan_summary(rows, "lang", chapter=["doc_id", "chapter_index"], boundary=None), "longest").drop("hard_splits", "spoken_chars")
