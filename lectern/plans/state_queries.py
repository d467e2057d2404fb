"""Identity, state and work queries (I-*, B-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import identity as idf
from ..functions import text as tx
from ..operators import cache, identity, work
from .inputs import LINES, RECORDS, document_lines, documents, pages, records, table
from .registry import query

GENERATION = "generation-fingerprint"
MOD = fixed.SEED_MODULUS


def hex_number(expr: str) -> str:
    return f"('0x' || left({expr}, 8))::BIGINT"


_SEED = f"(20261001 + {hex_number('''sha256(to_json({'chapter': source, 'text': text})::VARCHAR)''')}) % {MOD}"

SEGMENT_IDS = f"""
seeded AS (SELECT *, {_SEED} AS seed FROM lines),
ids AS (SELECT *, sha256(to_json({{'generation': '{GENERATION}', 'seed': seed, 'text': text}})::VARCHAR) AS segment_id FROM seeded)
"""


def line_ids(spark, d) -> DataFrame:
    """Document lines with their seeds and identities; the source stands for the chapter title."""
    return identity.identify_segments(document_lines(spark, d), GENERATION, title="source")


@query("i1_digest", "SELECT doc_id, sha256(to_json({'lang': lang, 'n': n_chars, 'none': NULL, 'text': text})::VARCHAR) AS digest FROM documents")
def i1_digest(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", idf.digest(text=F.col("text"), lang=F.col("lang"), n=F.col("n_chars"), none=F.lit(None).cast("string")).alias("digest"))


@query("i2_content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def i2_content_hash(spark, d):
    return documents(spark, d).select("doc_id", idf.content_hash(F.col("text")).alias("content_sha256"))


@query("i3_segment_seed", f"WITH {LINES} SELECT doc_id, line_no, {_SEED} AS seed FROM lines")
def i3_segment_seed(spark, d):
    return line_ids(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "seed")


@query("i4_segment_id", f"WITH {LINES}, {SEGMENT_IDS} SELECT doc_id, line_no, segment_id, sha256(to_json(text)::VARCHAR) AS text_hash FROM ids")
def i4_segment_id(spark, d):
    return line_ids(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "segment_id", "text_hash")


@query("i5_occurrences", f"WITH {LINES}, {SEGMENT_IDS} SELECT segment_id, count(*) AS occurrences FROM ids GROUP BY 1")
def i5_occurrences(spark, d):
    return identity.occurrences(line_ids(spark, d))


QUALITY = {"max_retry": 3, "min_duration": 0.4, "max_cer": 0.15, "silence_db": -45, "asr_timeout": 300}
POLICY = identity.policy_hash(QUALITY)


@query("i6_policy_hash", """
SELECT doc_id, sha256('{"asr_model":null,"qc_version":1,"quality":{"max_cer":0.15,"min_duration":0.4,"silence_db":-45}}') AS policy, quality = 1 AS pass FROM labels""")
def i6_policy_hash(spark, d):
    """Every verdict carries the policy it was reached under."""
    return table(spark, d, "labels").select("doc_id", F.lit(POLICY).alias("policy"), (F.col("quality") == 1).alias("pass"))


@query("i7_manifest_signature", """
SELECT o_orderkey, sha256(CASE WHEN o_custkey % 3 = 0
  THEN '{"chapter_selection":[' || least(o_custkey % 5, o_custkey % 7) || ',' || greatest(o_custkey % 5, o_custkey % 7) || '],"config":' || config || ',"generator":"' || o_orderstatus || '","source":"' || o_custkey || '"}'
  ELSE '{"config":' || config || ',"generator":"' || o_orderstatus || '","source":"' || o_custkey || '"}' END) AS signature
FROM (SELECT *, '{' || CASE WHEN o_orderkey % 2 = 0 THEN '"output.speech_rate":"1.2",' ELSE '' END || '"segment.max":"' || o_orderkey % 4 || '"}' AS config FROM orders)""")
def i7_manifest_signature(spark, d):
    """Batch size never counts; neutral settings count as absent."""
    orders = table(spark, d, "orders")
    settings = F.create_map(
        F.lit("tts.batch_size"), (F.col("o_custkey") % 8).cast("string"), F.lit("segment.max"), (F.col("o_orderkey") % 4).cast("string"),
        F.lit("output.speech_rate"), F.when(F.col("o_orderkey") % 2 == 0, "1.2").otherwise("1.0"), F.lit("text.strip_front_matter"), F.lit("false"))
    picked = F.when(F.col("o_custkey") % 3 == 0, F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7))
    signature = identity.manifest_signature(F.col("o_custkey").cast("string"), settings, F.col("o_orderstatus"), picked,
                                            {"output.speech_rate": "1.0", "text.strip_front_matter": "false"})
    return orders.select("o_orderkey", signature.alias("signature"))


@query("i8_render_fingerprint", f"""
WITH {LINES}, {SEGMENT_IDS},
s AS (SELECT doc_id, source, string_agg('["' || segment_id || '","' || sha256(text) || '","' || CASE WHEN line_no % 2 = 0 THEN 'paragraph' ELSE 'sentence' END || '"]', ',' ORDER BY line_no) AS body FROM ids GROUP BY ALL)
SELECT doc_id, sha256('{{"audio_version":1,"output":"neutral","segments":[' || body || '],"title":"' || source || '"}}') AS fingerprint FROM s""")
def i8_render_fingerprint(spark, d):
    rows = line_ids(spark, d).withColumn("content_sha256", idf.content_hash(F.col("text"))).withColumn(
        "boundary", F.when(F.col("line_no") % 2 == 0, "paragraph").otherwise("sentence"))
    return identity.render_fingerprint(rows, ["doc_id"], F.col("source"), "neutral", order="line_no")


@query("i9_artifact_valid", """
WITH f AS (SELECT doc_id // 4 AS artifact, doc_id % 7 <> 3 AS kept, doc_id % 11 <> 5 AS intact, doc_id // 4 % 9 <> 2 AS same FROM documents)
SELECT artifact, bool_and(kept AND intact AND same) AS valid, count(*) AS files FROM f GROUP BY 1""")
def i9_artifact_valid(spark, d):
    """Documents as files of artifacts of four; some vanished, some changed, some under another fingerprint."""
    files = documents(spark, d).select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("artifact"), F.col("doc_id").alias("path"),
                                       idf.content_hash(F.col("text")).alias("sha256"), F.lit("fp").alias("fingerprint"))
    current = files.filter(F.col("path") % 7 != 3).withColumn(
        "sha256", F.when(F.col("path") % 11 == 5, "changed").otherwise(F.col("sha256"))).withColumn(
        "fingerprint", F.when(F.col("artifact") % 9 == 2, "other").otherwise(F.col("fingerprint")))
    return identity.artifact_valid(files, current, "artifact")


def part_state(spark, d) -> DataFrame:
    """One state record per part."""
    size = F.col("p_size")
    status = F.when(size % 4 == 0, "failed").when(size % 4 == 1, "running").otherwise("completed")
    return table(spark, d, "part").filter(F.col("p_brand") != "Brand#1").select(
        F.col("p_partkey").alias("segment_id"), status.alias("status"), (size % 7).cast("int").alias("attempts"),
        F.when(size % 5 == 0, "old").otherwise(F.lit(POLICY)).alias("qc_hash"), F.col("p_name").alias("content_sha256"))


@query("i10_classify_segments", f"""
WITH {RECORDS}, s AS (SELECT p_partkey AS segment_id, CASE p_size % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status, p_size % 7 AS attempts,
  p_size % 5 = 0 AS stale, p_partkey % 6 <> 0 AS present, p_partkey % 10 <> 1 AS intact FROM part WHERE p_brand <> 'Brand#1'),
n AS (SELECT segment_id, count(*) AS occurrences FROM records GROUP BY 1)
SELECT segment_id, occurrences, CASE WHEN status = 'completed' AND present AND intact THEN CASE WHEN stale THEN 'recheck' ELSE 'cached' END
  WHEN status = 'failed' AND NOT stale AND attempts >= 4 THEN 'exhausted' ELSE 'pending' END AS verdict FROM n LEFT JOIN s USING (segment_id)""")
def i10_classify_segments(spark, d):
    state = part_state(spark, d)
    files = table(spark, d, "part").filter(F.col("p_partkey") % 6 != 0).select(
        F.col("p_partkey").alias("segment_id"), F.when(F.col("p_partkey") % 10 == 1, "corrupt").otherwise(F.col("p_name")).alias("sha256"))
    return cache.classify_segments(records(spark, d), state, files, POLICY).select("segment_id", "occurrences", "verdict")


@query("i11_reuse_cache", """
WITH c AS (SELECT doc_id, lang AS signature, source AS stem, sha256(text) AS segment_id FROM documents),
done AS (SELECT DISTINCT segment_id FROM c JOIN labels USING (doc_id) WHERE quality = 1),
prev AS (SELECT *, row_number() OVER (PARTITION BY signature, segment_id ORDER BY doc_id DESC) AS r FROM c WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 1 AND doc_id % 9 <> 2)
SELECT DISTINCT w.signature, w.segment_id, p.doc_id AS run_order FROM c w JOIN prev p ON p.signature = w.signature AND p.segment_id = w.segment_id AND p.r = 1
WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.segment_id = w.segment_id)""")
def i11_reuse_cache(spark, d):
    """Exact copies of a document stand for earlier runs; labelled good ones are already local."""
    docs = documents(spark, d).select("doc_id", F.col("lang").alias("signature"), idf.content_hash(F.col("text")).alias("segment_id"))
    number = F.col("doc_id")
    previous = docs.select(
        "signature", "segment_id", number.alias("run_order"), F.when(number % 5 == 0, "running").otherwise("failed").alias("run_status"),
        F.when(number % 7 == 1, "failed").otherwise("completed").alias("status"), F.col("segment_id").alias("content_sha256"),
        F.when(number % 9 == 2, "damaged").otherwise(F.col("segment_id")).alias("file_sha256"))
    local = docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id").withColumn("status", F.lit("completed"))
    return cache.reuse_cache(docs, local, previous, ["signature"]).select("signature", "segment_id", "run_order")


@query("i11_reuse_on_four", """
WITH c AS (SELECT doc_id, lang AS signature, lower(source) AS stem, doc_id % 3 AS source_hash, n_chars % 2 AS fingerprint, sha256(text) AS segment_id FROM documents),
prev AS (SELECT *, row_number() OVER (PARTITION BY signature, stem, source_hash, fingerprint, segment_id ORDER BY doc_id DESC) AS r FROM c WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 1 AND doc_id % 9 <> 2)
SELECT DISTINCT w.signature, w.stem, w.source_hash, w.fingerprint, w.segment_id, p.doc_id AS run_order FROM c w JOIN prev p USING (signature, stem, source_hash, fingerprint, segment_id) WHERE p.r = 1""")
def i11_reuse_on_four(spark, d):
    """Earlier work is taken over only where speech signature, file stem, source and fingerprint all agree."""
    match = ["signature", "stem", "source_hash", "fingerprint"]
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("signature"), F.lower("source").alias("stem"), (F.col("doc_id") % 3).alias("source_hash"),
                                               (F.col("n_chars") % 2).alias("fingerprint"), F.sha2("text", 256).alias("segment_id"))
    number = F.col("doc_id")
    previous = docs.select(
        *match, "segment_id", number.alias("run_order"), F.when(number % 5 == 0, "running").otherwise("failed").alias("run_status"),
        F.when(number % 7 == 1, "failed").otherwise("completed").alias("status"), F.col("segment_id").alias("content_sha256"),
        F.when(number % 9 == 2, "damaged").otherwise(F.col("segment_id")).alias("file_sha256"))
    local = docs.limit(0).withColumn("status", F.lit("completed"))
    return cache.reuse_cache(docs, local, previous, match).select(*match, "segment_id", "run_order")


@query("i12_latest_state", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def i12_latest_state(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return cache.latest_state(log, "user_id", stamp=["ts", "event_id"]).drop("ts")


@query("i13_safe_name", """
SELECT page_id, left(trim(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .'), 60) AS name,
  CASE WHEN page_id % 4 = 0 THEN '_con.' || page_id WHEN page_id % 4 = 1 THEN 'book' ELSE 'com' || page_id % 2 || 'x' END AS guarded FROM pages""")
def i13_safe_name(spark, d):
    number = F.col("page_id").cast("string")
    odd = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("con."), number)).when(F.col("page_id") % 4 == 1, F.lit(" ... ")).otherwise(
        F.concat(F.lit("com"), (F.col("page_id") % 2).cast("string"), F.lit("x. ")))
    return pages(spark, d).select("page_id", tx.safe_name(F.col("url")).alias("name"), tx.safe_name(odd).alias("guarded"))


@query("i14_book_id", """
SELECT page_id, CASE WHEN s = '' THEN 'book' ELSE s END || '-' || left(sha256(to_json(url)::VARCHAR), 10) AS book_id FROM (
  SELECT page_id, url, left(trim(regexp_replace(string_split(url, '/')[-1], '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ' .'), 40) AS s FROM pages)""")
def i14_book_id(spark, d):
    return pages(spark, d).select("page_id", identity.book_id(F.col("url"), F.substring_index("url", "/", -1)).alias("book_id"))


@query("i15_plan_signature", """
WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey::VARCHAR)) AS files FROM orders GROUP BY 1)
SELECT o_custkey, len(files)::BIGINT AS files_n, sha256('{"chapters":"' || o_custkey % 3 || '","files":' || to_json(files)::VARCHAR || '}') AS signature FROM g""")
def i15_plan_signature(spark, d):
    files = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("file"), (F.col("o_custkey") % 3).cast("string").alias("chapters"))
    return identity.plan_signature(files, "o_custkey", "file", "chapters").withColumn("files_n", F.col("files_n").cast("bigint"))


# ---- work --------------------------------------------------------------------------------------------------------

BATCHES = """
b1 AS (SELECT doc_id, line_no, text, (line_no - 1) // 16 AS stretch, floor(ln(length(text)) / ln(1.6))::BIGINT AS length_bucket FROM lines),
batches AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, stretch, length_bucket ORDER BY line_no) - 1) // 4 AS batch_no FROM b1)
"""


def line_batches(spark, d) -> DataFrame:
    lines = document_lines(spark, d).withColumn("line_no", F.col("line_no").cast("bigint"))
    return work.plan_batches(lines, ["doc_id"], "line_no", F.length("text"), 4)


@query("b1_plan_batches", f"WITH {LINES}, {BATCHES} SELECT doc_id, line_no, stretch, length_bucket, batch_no FROM batches")
def b1_plan_batches(spark, d):
    return line_batches(spark, d).select("doc_id", "line_no", *work.BATCH_KEY)


@query("b1_batch_invariants", f"WITH {LINES}, {BATCHES} SELECT doc_id, count(*) AS batches, true AS within_size, true AS within_ratio FROM (SELECT DISTINCT doc_id, stretch, length_bucket, batch_no FROM batches) GROUP BY 1")
def b1_batch_invariants(spark, d):
    n = F.length("text")
    per_batch = line_batches(spark, d).groupBy("doc_id", *work.BATCH_KEY).agg(F.count("*").alias("n"), (F.max(n) / F.min(n)).alias("ratio"))
    return per_batch.groupBy("doc_id").agg(F.count("*").alias("batches"), F.bool_and(F.col("n") <= 4).alias("within_size"),
                                           F.bool_and(F.col("ratio") <= fixed.LENGTH_RATIO).alias("within_ratio"))


@query("b2_dedupe_in_batch", f"WITH {LINES}, {SEGMENT_IDS} SELECT source, count(DISTINCT segment_id) AS once, count(*) AS planned FROM ids GROUP BY 1")
def b2_dedupe_in_batch(spark, d):
    unique = identity.occurrences(line_ids(spark, d), "source")
    return unique.groupBy("source").agg(F.count("*").alias("once"), F.sum("occurrences").alias("planned"))


@query("b3_batch_identity", f"""
WITH {LINES}, {BATCHES}, g AS (SELECT doc_id, stretch, length_bucket, batch_no, count(*) AS members, min(line_no * 31) AS own,
  sha256('[' || string_agg('[' || to_json(text)::VARCHAR || ',' || line_no * 31 || ']', ',' ORDER BY line_no) || ']') AS batch_id FROM batches GROUP BY ALL)
SELECT doc_id, stretch, length_bucket, batch_no, members, batch_id, CASE WHEN members = 1 THEN own ELSE {hex_number('batch_id')} % {MOD} END AS batch_seed FROM g""")
def b3_batch_identity(spark, d):
    seeded = line_batches(spark, d).withColumn("seed", F.col("line_no") * 31)
    rows = work.batch_identity(seeded, ["doc_id", *work.BATCH_KEY], "line_no")
    return rows.withColumn("members", F.col("members").cast("bigint"))


@query("b4_amortize_metrics", f"""
WITH {RECORDS}, t AS (SELECT r.*, o_custkey::DOUBLE AS batch_seconds FROM records r JOIN orders ON o_orderkey = job_id)
SELECT job_id, seg_index, supplier, cents, count(*) OVER w AS batch_size, sum(duration) OVER w AS batch_audio_seconds, batch_seconds / count(*) OVER w AS generation_seconds,
  batch_seconds / greatest(sum(duration) OVER w, 0.001) AS rtf FROM t WINDOW w AS (PARTITION BY job_id)""")
def b4_amortize_metrics(spark, d):
    seconds = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").cast("double").alias("batch_seconds"))
    rows = work.amortize_metrics(records(spark, d).join(seconds, "job_id"), ["job_id"], "batch_seconds", "duration")
    return rows.select("job_id", "seg_index", "supplier", "cents", "batch_size", "batch_audio_seconds", "generation_seconds", "rtf")


def _retry() -> Column:
    return F.col("supplier") % 10 == 0


@query("b5_initial_attempt", f"""
WITH {RECORDS} SELECT job_id, seg_index, segment_id, cents, CASE WHEN status = 'completed' OR supplier % 10 = 0 OR discount % 3 = 0 THEN 0 WHEN status = 'generated' THEN greatest(seg_index - 1, 0) ELSE seg_index END AS attempt,
  (supplier * 10000019 + CASE WHEN status = 'completed' OR supplier % 10 = 0 OR discount % 3 = 0 THEN 0 WHEN status = 'generated' THEN greatest(seg_index - 1, 0) ELSE seg_index END) % {MOD} AS seed FROM records""")
def b5_initial_attempt(spark, d):
    """B-5 with the seed of that attempt (B-6)."""
    attempt = work.initial_attempt(F.col("status"), F.col("seg_index"), F.col("discount") % 3 != 0, _retry())
    rows = records(spark, d).withColumn("attempt", attempt.cast("bigint"))
    return rows.select("job_id", "seg_index", "segment_id", "cents", "attempt", idf.attempt_seed(F.col("supplier") * 10000019, F.col("attempt")).alias("seed"))


@query("b6_attempt_seed", f"WITH {LINES}, {SEGMENT_IDS} SELECT doc_id, line_no, (seed + 2147483640 + line_no) % {MOD} AS seed FROM ids")
def b6_attempt_seed(spark, d):
    rows = line_ids(spark, d).withColumn("line_no", F.col("line_no").cast("bigint"))
    return rows.select("doc_id", "line_no", idf.attempt_seed(F.col("seed"), F.lit(2147483640).cast("bigint") + F.col("line_no")).alias("seed"))


@query("b7_attempt_history", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS history FROM r WHERE back <= 32 GROUP BY 1""")
def b7_attempt_history(spark, d):
    history = work.attempt_history(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    text = F.transform("history", lambda h: F.concat_ws(":", h["event_id"].cast("string"), h["event_type"]))
    return history.select("user_id", F.array_join(text, ",").alias("history"))


def measured(texts: list[str]) -> list[float]:
    """A scorer that refuses whole batches with a faulty text in them."""
    if any("token" in t for t in texts):
        raise RuntimeError("faulty text")
    return [float(len(t)) for t in texts]


@query("b8_score_batches", f"""
WITH {LINES} SELECT doc_id || ':' || line_no AS item_id, CASE WHEN contains(text, 'token') THEN NULL ELSE length(text)::DOUBLE END AS score,
  CASE WHEN contains(text, 'token') THEN 'RuntimeError: faulty text' END AS error FROM lines""")
def b8_score_batches(spark, d):
    batched = line_batches(spark, d).withColumn("item", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")))
    return work.score_batches(batched, measured, ["doc_id", *work.BATCH_KEY], "item", order="line_no").select("item_id", "score", "error")


def transcribed(texts: list[str]) -> list[str]:
    """Stands in for a recogniser that hears every e as a 3."""
    return [t.replace("e", "3") for t in texts]


@query("b8_transcribe_batches", f"WITH {LINES} SELECT doc_id || ':' || line_no AS item_id, replace(text, 'e', '3') AS transcript FROM lines")
def b8_transcribe_batches(spark, d):
    """A user function that returns texts."""
    batched = line_batches(spark, d).withColumn("item", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string")))
    heard = work.score_batches(batched, transcribed, ["doc_id", *work.BATCH_KEY], "item", order="line_no", result="string")
    return heard.select("item_id", F.col("score").alias("transcript"))


@query("b9_retry_loop", """
SELECT doc_id, CASE WHEN doc_id % 6 <= 3 THEN doc_id % 6 + 1 ELSE 4 END AS attempts, CASE WHEN doc_id % 6 <= 3 THEN 'completed' ELSE 'exhausted' END AS status FROM documents""")
def b9_retry_loop(spark, d):
    """An item passes at the attempt equal to its number modulo six, if it is given that many."""
    def step(pending: DataFrame, attempt: int) -> DataFrame:
        return pending.select("doc_id", (F.col("doc_id") % 6 == attempt).alias("passed"))
    done = work.retry_loop(table(spark, d, "documents").select("doc_id"), step, "doc_id")
    return done.select("doc_id", F.col("attempts").cast("int").alias("attempts"), "status")


@query("b10_checkpoint_limit", f"""WITH {RECORDS} SELECT job_id, seg_index, segment_id, cents FROM records WHERE status <> 'completed' ORDER BY job_id, seg_index, segment_id, cents, supplier LIMIT 500""")
def b10_checkpoint_limit(spark, d):
    pending = records(spark, d).filter(F.col("status") != "completed")
    return work.checkpoint_limit(pending, ["job_id", "seg_index", "segment_id", "cents", "supplier"], 500).select("job_id", "seg_index", "segment_id", "cents")
