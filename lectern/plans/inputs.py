"""Access to the input tables, and derived tables that several queries share (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rows import unnest

# A short line that is one sentence; used as the heading pattern on generated prose.
SENTENCE_LINE = r"[^.]{1,58}\."

BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
PARTS_PER_SPLIT = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python are bounded by their bytes: by the number of rows alone, one holds ever more as a split of the input grows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table over all cores before per-row text work, only if its scan has too few splits for that.

    A large table has more splits than cores and is left alone. A table of some splits gets more parts than cores, so that what a task reads is a part
    of a split; Spark deals tables of the same number of parts to the same tasks where they are united.
    """
    small_batches(df.sparkSession)
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits > cores else df.repartition(max(cores, PARTS_PER_SPLIT * splits), *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "pages"), "page_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines as segments: ``doc_id, lang, source, line_no, text``."""
    docs = documents(spark, sf_dir)
    rows = unnest(docs, tx.lines("text"), "doc_id", "lang", "source", at="_p", value="text")
    return rows.filter(tx.strip("text") != "").select("doc_id", "lang", "source", (F.col("_p") + 1).alias("line_no"), "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as segment records of a job (the order); the part is the content identity."""
    items = table(spark, sf_dir, "lineitem")
    status = (F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed")
              .when(F.col("l_linestatus") == "O", "generated").otherwise("pending"))
    return items.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("seg_index"),
        F.col("l_partkey").alias("segment_id"), F.col("l_suppkey").alias("supplier"), status.alias("status"),
        F.col("l_quantity").alias("duration"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        F.col("l_shipdate").alias("shipped_at"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    orders = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "queued")
              .when(F.col("o_orderpriority") == "1-URGENT", "running").when(F.col("o_orderpriority") == "5-LOW", "paused").otherwise("failed"))
    return orders.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_orderpriority").alias("priority"))


# ---- SQL twins ---------------------------------------------------------------------------------------------------

WS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||"
      "chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||"
      "chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")


def sql_lines(expr: str) -> str:
    """Lines of a text whose only separator is a line feed."""
    parts = f"string_split({expr}, chr(10))"
    return f"(CASE WHEN {expr} = '' THEN CAST([] AS VARCHAR[]) WHEN ends_with({expr}, chr(10)) THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END)"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sql_tidy(expr: str) -> str:
    """Blank runs, line edges and empty-line runs of a text without exotic separators."""
    spaced = f"regexp_replace(translate({expr}, chr(160)||chr(12288), '  '), '[ \\t]+', ' ', 'g')"
    trimmed = f"array_to_string(list_transform(string_split({spaced}, chr(10)), lambda x: {sql_strip('x')}), chr(10))"
    return sql_strip(f"regexp_replace({trimmed}, '\\n{{3,}}', chr(10)||chr(10), 'g')")


def sql_html(expr: str) -> str:
    """Visible text of the pages' markup, before character references are decoded."""
    out = f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "head", "nav", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    out = (f"regexp_replace({out}, '(?i)</?(p|div|section|article|blockquote|h1|h2|h3|h4|h5|h6|li|tr|br)(\\s[^>]*)?/?>', chr(10), 'g')")
    return f"regexp_replace({out}, '<[a-zA-Z/!?][^>]*>', '', 'g')"


def sql_unescape(expr: str) -> str:
    """The character references that occur in the pages."""
    return (f"nfc_normalize(replace(replace(replace(replace({expr}, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '\"'), '&amp;', '&'))")


def sql_references(expr: str) -> str:
    """The same references, which HTML also reads where the semicolon is missing: a title may be cut right before it."""
    out = expr
    for name, char in (("middot", "chr(183)"), ("copy", "chr(169)"), ("quot", "'\"'"), ("amp", "'&'")):
        out = f"regexp_replace({out}, '&{name};?', {char}, 'g')"
    return f"nfc_normalize({out})"


LINES = f"""
lines AS (
  SELECT doc_id, lang, source, line_no, text FROM (
    SELECT doc_id, lang, source, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line_no
    FROM (SELECT doc_id, lang, source, {sql_lines('text')} AS ls FROM documents))
  WHERE {sql_strip('text')} <> '')
"""

RECORDS = """
records AS (
  SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS seg_index, l_partkey AS segment_id, l_suppkey AS supplier,
    CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed'
         WHEN l_linestatus = 'O' THEN 'generated' ELSE 'pending' END AS status,
    l_quantity AS duration, round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::BIGINT AS discount,
    round(l_tax * 100)::BIGINT AS tax, l_shipdate AS shipped_at
  FROM lineitem)
"""

JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS owner,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'queued'
         WHEN o_orderpriority = '1-URGENT' THEN 'running' WHEN o_orderpriority = '5-LOW' THEN 'paused' ELSE 'failed' END AS status,
    o_orderdate AS created_at, round(o_totalprice * 100)::BIGINT AS cents, o_orderpriority AS priority
  FROM orders)
"""
