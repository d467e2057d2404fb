"""Quality and reference clip queries (Q-*, SRC-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import unnest
from ..operators import clips as cp
from ..operators import quality as ql
from ..operators import select as sl
from ..session import workspace
from ..sources import readers
from .inputs import balanced, conversations, table
from .registry import query

# Accented letters mapped one to one onto capitals, because the SQL engine measures edit distance in bytes.
ACCENTS, CAPITALS = "éóèñçüêäößí", "ABCDEFGHIJK"


def sql_normal(expr: str) -> str:
    return f"translate(lower(regexp_replace(nfc_normalize({expr}), '[^\\p{{L}}\\p{{N}}]', '', 'g')), '{ACCENTS}', '{CAPITALS}')"


_HEARD = "replace(replace(replace(text, 'ou', 'u'), ' la ', ' '), 'é', 'éé')"
COMPARED = f"""
p AS (SELECT conv_id, turn, {sql_normal('text')} AS r, {sql_normal(_HEARD)} AS h FROM conversations),
c AS (SELECT *, levenshtein(r, h) AS distance FROM p)
"""


def pairs(spark, d) -> DataFrame:
    """Turns beside a noisy transcript of themselves, whole texts."""
    heard = F.replace(F.replace(F.replace("text", F.lit("ou"), F.lit("u")), F.lit(" la "), F.lit(" ")), F.lit("é"), F.lit("éé"))
    return balanced(conversations(spark, d), "conv_id", "turn").withColumn("transcript", heard)


@query("q1_cer", f"""
WITH {COMPARED} SELECT conv_id, turn, distance, distance / greatest(length(r), 1) AS cer, greatest(0.0, 1 - distance / greatest(length(r), length(h), 1)) AS similarity FROM c""")
def q1_cer(spark, d):
    rows = ql.compare_text(pairs(spark, d), "text", "transcript")
    return rows.select("conv_id", "turn", F.col("distance").cast("bigint").alias("distance"), "cer", "similarity")


@query("q2_edit_ops", f"WITH {COMPARED} SELECT conv_id, turn, distance AS edits, length(h) - length(r) AS balance FROM c")
def q2_edit_ops(spark, d):
    """The split of an alignment is not unique; its total and its insertions minus deletions are."""
    rows = ql.edit_ops(ql.compare_text(pairs(spark, d), "text", "transcript"))
    return rows.select("conv_id", "turn", (F.col("insertions") + F.col("deletions") + F.col("substitutions")).cast("bigint").alias("edits"),
                       (F.col("insertions") - F.col("deletions")).cast("bigint").alias("balance"))


@query("j9_recheck_transcripts", f"WITH {COMPARED} SELECT conv_id, turn, distance / greatest(length(r), 1) <= 0.15 AS pass FROM c")
def j9_recheck_transcripts(spark, d):
    return sl.recheck_transcripts(pairs(spark, d), None, "key").select("conv_id", "turn", "pass")


def _reasons(*cases: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in cases) + "], lambda x: x IS NOT NULL)"


_SPEED = [("duration < 0.4", "too_short"), ("chars / greatest(duration, 0.001) > 14", "possible_missing_text_or_too_short"),
          ("chars > 5 AND chars / greatest(duration, 0.001) < 0.7", "possible_repetition_or_too_long")]


@query("q3_speed_rules", f"""
WITH t AS (SELECT conv_id, turn, length(text) AS chars, length(text) * (conv_id % 20) / 64.0 / (turn + 1) AS duration FROM conversations)
SELECT conv_id, turn, chars / greatest(duration, 0.001) AS chars_per_second, array_to_string({_reasons(*_SPEED)}, ',') AS reasons FROM (SELECT conv_id, turn, chars, duration::DOUBLE AS duration FROM t)""")
def q3_speed_rules(spark, d):
    chars = F.length("text")
    duration = (chars * (F.col("conv_id") % 20) / F.lit(64.0) / (F.col("turn") + 1))
    return conversations(spark, d).select("conv_id", "turn", ql.speed(chars, duration).alias("chars_per_second"),
                                          F.array_join(ql.speed_reasons(chars, duration), ",").alias("reasons"))


def signal(spark, d) -> DataFrame:
    """Vectors as clips, four times as loud: some mono, some stereo, some empty, some with a broken sample."""
    loud = F.transform("embedding", lambda x: x.cast("double") * 4)
    number = F.col("vec_id")
    broken = F.transform(loud, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))
    samples = F.when(number % 13 == 0, F.array().cast("array<double>")).when(number % 11 == 0, broken).otherwise(loud)
    return table(spark, d, "embeddings").select(
        "vec_id", "label", samples.alias("samples"), loud.alias("loud"), F.lit(20).alias("rate"),
        (number % 2 + 1).alias("channels"), (number * 7 % 60).alias("chars"))


SIGNAL = """
loud AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 4) AS s, 1 + vec_id % 2 AS channels, vec_id * 7 % 60 AS chars,
  CASE WHEN vec_id % 13 = 0 OR vec_id % 11 = 0 THEN false ELSE true END AS ok FROM embeddings)
"""
_QUIET = "power(10, -45 / 20.0)"


@query("q4_peak_and_clipping", f"""
WITH {SIGNAL} SELECT vec_id, list_max(list_transform(s, lambda x: abs(x))) AS peak, len(list_filter(s, lambda x: abs(x) >= 0.999)) / len(s) AS clipping_ratio,
  list_max(list_transform(s, lambda x: abs(x))) < {_QUIET} AS silent FROM loud""")
def q4_peak_and_clipping(spark, d):
    peak = ql.peak(F.col("loud"))
    return signal(spark, d).select("vec_id", peak.alias("peak"), ql.clipping_ratio(F.col("loud")).alias("clipping_ratio"),
                                   (peak < ql.level(-45)).alias("silent"))


@query("q5_frame_rms", f"""
WITH {SIGNAL}, x AS (SELECT vec_id, unnest(s) AS x, unnest(range(0, len(s))) // 9 AS frame_no FROM loud)
SELECT vec_id, frame_no, round(sqrt(avg(x * x)), 9) AS rms FROM x GROUP BY ALL HAVING count(*) = 9""")
def q5_frame_rms(spark, d):
    """Frames of nine samples, so that a partial one is left over."""
    frames = ql.frame_rms(F.col("loud"), ql.frame_size(F.lit(450)))
    rows = unnest(signal(spark, d), frames, "vec_id", at="frame_no", value="rms")
    return rows.select("vec_id", F.col("frame_no").cast("bigint").alias("frame_no"), F.round("rms", 9).alias("rms"))


SILENCE = """
m AS (SELECT user_id, value < 20 AS hit, row_number() OVER w AS n, sum((value < 20)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, n - hits AS run, count(*) AS len FROM m WHERE hit GROUP BY ALL)
SELECT user_id, coalesce(max(len), 0)::BIGINT AS longest_run, coalesce(max(len), 0) * 0.02::DOUBLE AS max_silence_seconds, coalesce(max(len), 0) * 0.02::DOUBLE > 3 AS long_silence
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN r USING (user_id) GROUP BY user_id"""


def silence(spark, d, **scan) -> DataFrame:
    frames = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    rows = ql.longest_silence(frames, ["user_id"], ["ts", "event_id"], F.col("value") < 20, **scan)
    return rows.withColumn("longest_run", F.col("longest_run").cast("bigint"))


@query("q6_longest_silence", f"WITH {SILENCE}")
def q6_longest_silence(spark, d):
    return silence(spark, d)


@query("q6_longest_silence_spread", f"WITH {SILENCE}")
def q6_longest_silence_spread(spark, d):
    """The same runs with every user treated as too large for one task."""
    return silence(spark, d, parts=40)


@query("q7_finite_check", f"WITH {SIGNAL} SELECT vec_id, ok AS usable FROM loud")
def q7_finite_check(spark, d):
    return signal(spark, d).select("vec_id", ql.usable(F.col("samples")).alias("usable"))


CHECKED = f"""
{SIGNAL},
base AS (
  SELECT vec_id, label, chars, ok, (len(s) // channels) / 20 AS duration, list_max(list_transform(s, lambda x: abs(x))) AS peak,
    len(list_filter(s, lambda x: abs(x) >= 0.999)) / len(s) AS clipping_ratio,
    CASE WHEN channels = 1 THEN s ELSE list_transform(range(0, len(s) // 2), lambda k: (s[2 * k + 1] + s[2 * k + 2]) / 2) END AS mono FROM loud),
fr AS (SELECT vec_id, unnest(mono) AS x, unnest(range(0, len(mono))) AS i FROM base),
fl AS (SELECT vec_id, i, abs(x) < {_QUIET} AS q FROM fr),
rn AS (SELECT vec_id, q, i - sum(q::INT) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM fl),
mx AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, g, count(*) AS n FROM rn WHERE q GROUP BY ALL) GROUP BY 1),
checked AS (
  SELECT vec_id, label, ok, duration, coalesce(run, 0) * 0.02::DOUBLE AS max_silence_seconds,
    CASE WHEN NOT ok THEN ['empty_or_nonfinite_audio'] ELSE {_reasons(*_SPEED, (f"peak < {_QUIET}", "silent_audio"), ("clipping_ratio > 0.02", "excessive_clipping"), ("coalesce(run, 0) * 0.02 > 3", "long_silence"))} END AS reasons
  FROM base LEFT JOIN mx USING (vec_id))
"""


@query("q8_check_clips", f"""WITH {CHECKED} SELECT vec_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS pass,
  CASE WHEN ok THEN duration END AS duration, CASE WHEN ok THEN max_silence_seconds END AS max_silence_seconds FROM checked""")
def q8_check_clips(spark, d):
    rows = ql.check_clips(signal(spark, d))
    return rows.select("vec_id", F.array_join("reasons", ",").alias("reasons"), "pass", "duration", "max_silence_seconds")


@query("q8_verdict", f"""WITH {CHECKED} SELECT vec_id, CASE WHEN len(reasons) = 0 AND label / 20.0 > 0.15 THEN 'asr_cer_exceeded' ELSE array_to_string(reasons, ',') END AS reasons,
  len(reasons) = 0 AND label / 20.0 <= 0.15 AS pass FROM checked""")
def q8_verdict(spark, d):
    rows = ql.verdict(ql.check_clips(signal(spark, d)).withColumn("cer", F.col("label") / 20))
    return rows.select("vec_id", F.array_join("reasons", ",").alias("reasons"), "pass")


RANGES = """
c AS (SELECT user_id, event_id, floor(value) AS s, floor(value) + event_id % 20 AS e, floor(value) * 4 + event_id % 3 * 5 AS dur FROM events),
t AS (SELECT *, sum(e - s) OVER w AS total, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, total AS selected_seconds, CASE WHEN NOT (s >= 0 AND s < e AND e <= dur + 0.05) THEN 'invalid_range' WHEN dur > 600 THEN 'source_too_long'
  WHEN n > 5 THEN 'too_many_clips' WHEN total > 60 THEN 'selection_too_long' END AS error FROM t"""


def ranges(spark, d, **scan) -> DataFrame:
    start = F.floor("value").cast("double")
    events = table(spark, d, "events").select("user_id", "event_id", start.alias("start"), (start + F.col("event_id") % 20).alias("end"),
                                              (start * 4 + F.col("event_id") % 3 * 5).alias("duration"))
    return cp.check_ranges(events, ["user_id"], "event_id", **scan).select("user_id", "event_id", "selected_seconds", "error")


@query("q9_clip_range_check", f"WITH {RANGES}")
def q9_clip_range_check(spark, d):
    return ranges(spark, d)


@query("q9_clip_range_check_spread", f"WITH {RANGES}")
def q9_clip_range_check_spread(spark, d):
    return ranges(spark, d, parts=40)


@query("q9_broken_ranges", """
WITH c AS (SELECT user_id, event_id, value AS s, CASE event_id % 13 WHEN 0 THEN 1e300 ELSE value + event_id % 7 END AS e, CASE event_id % 11 WHEN 0 THEN 1e300 WHEN 1 THEN NULL ELSE 200.0 END AS dur,
  event_id % 13 IN (1, 2) AS broken FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  sum(CASE WHEN NOT broken AND e < 1e15 AND dur IS NOT NULL THEN round(e - s, 9) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM c)
SELECT user_id, event_id, CASE WHEN broken OR dur IS NULL OR NOT (s >= 0 AND s < e AND e <= dur + 0.05) THEN 'invalid_range' WHEN dur > 600 THEN 'source_too_long'
  WHEN n > 5 THEN 'too_many_clips' WHEN total > 60 THEN 'selection_too_long' END AS error FROM t""")
def q9_broken_ranges(spark, d):
    """Ends that are huge, infinite or no number, and lengths that are missing, among good ranges."""
    k = F.col("event_id")
    end = F.when(k % 13 == 0, F.lit(1e300)).when(k % 13 == 1, F.lit(float("nan"))).when(k % 13 == 2, F.lit(float("inf"))).otherwise(F.col("value") + k % 7)
    length = F.when(k % 11 == 0, F.lit(1e300)).when(k % 11 != 1, F.lit(200.0))
    events = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("start"), end.alias("end"), length.alias("duration"))
    return cp.check_ranges(events, ["user_id"], "event_id").select("user_id", "event_id", "error")


@query("q10_edge_trim", f"""
WITH {SIGNAL}, p AS (SELECT vec_id, s, greatest(0.002, 0.5 * list_max(list_transform(s, lambda x: abs(x)))) AS thr FROM loud),
b AS (SELECT vec_id, s, list_position(list_transform(s, lambda x: abs(x) > thr), true) AS f, len(s) + 1 - list_position(list_transform(list_reverse(s), lambda x: abs(x) > thr), true) AS l FROM p),
k AS (SELECT vec_id, s, greatest(0, f - 1 - 3)::BIGINT AS first, least(len(s), l + 3)::BIGINT AS last FROM b)
SELECT vec_id, first, last, (last - first) / 20 AS trimmed_seconds, (last - first) / 20 < 1 AS too_short, round(list_sum(s[first + 1:last]), 9) AS kept FROM k""")
def q10_edge_trim(spark, d):
    rows = cp.trim_edges(signal(spark, d), "loud", "rate", relative=0.5)
    total = F.aggregate("trimmed", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "first", "last", "trimmed_seconds", "too_short", F.round(total, 9).alias("kept"))


@query("q11_level_warnings", f"""
WITH {SIGNAL} SELECT vec_id, array_to_string({_reasons(
    ("len(list_filter(s, lambda x: abs(x) >= 0.995)) / len(s) > 0.001", "clipping"), ("sqrt(list_sum(list_transform(s, lambda x: x * x)) / len(s)) < 0.5", "quiet"),
    ("len(list_filter(s, lambda x: abs(x) < 0.4)) / len(s) > 0.6", "silence"))}, ',') AS warnings, list_max(list_transform(s, lambda x: abs(x))) < 0.001 AS silent FROM loud""")
def q11_level_warnings(spark, d):
    warnings = cp.level_warnings(F.col("loud"), quiet=0.5, silent=0.4, silent_share=0.6)
    return signal(spark, d).select("vec_id", F.array_join(warnings, ",").alias("warnings"), cp.is_silent(F.col("loud")).alias("silent"))


@query("q12_conservative_gain", f"""
WITH {SIGNAL}, g AS (SELECT vec_id, s, least(4.0, 0.8 / list_max(list_transform(s, lambda x: abs(x)))) AS gain FROM loud)
SELECT vec_id, gain, list_max(list_transform(s, lambda x: abs(x * gain))) AS peak FROM g""")
def q12_conservative_gain(spark, d):
    return signal(spark, d).select("vec_id", cp.gain(F.col("loud")).alias("gain"), ql.peak(cp.apply_gain(F.col("loud"))).alias("peak"))


def _ref() -> Column:
    return F.when(F.col("label") < 4, F.floor(F.col("vec_id") / 3)).otherwise(1000000 + F.floor(F.col("vec_id") / 40)).cast("bigint")


@query("q13_join_clips", f"""
WITH {SIGNAL}, r AS (SELECT *, CASE WHEN label < 4 THEN vec_id // 3 ELSE 1000000 + vec_id // 40 END AS ref FROM loud),
g AS (SELECT ref, count(*) AS clips, string_agg('t' || vec_id, chr(10) ORDER BY vec_id) AS text, sum(len(s)) + count(*) - 1 AS n,
  round(sum(list_sum(s)), 6) AS total FROM r GROUP BY 1)
SELECT ref, clips, CASE WHEN clips <= 5 THEN text END AS text, CASE WHEN clips <= 5 THEN n::BIGINT END AS samples_n, CASE WHEN clips <= 5 THEN total END AS total,
  CASE WHEN clips <= 5 THEN CASE WHEN n / 8 < 3 THEN 'short' WHEN n / 8 > 30 THEN 'long' ELSE '' END END AS warnings, CASE WHEN clips > 5 THEN 'too_many_clips' WHEN n / 8 > 60 THEN 'reference_too_long' END AS error FROM g""")
def q13_join_clips(spark, d):
    clips = signal(spark, d).select(_ref().alias("ref"), "vec_id", F.col("loud").alias("samples"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("text"))
    rows = cp.join_clips(clips, ["ref"], "vec_id", rate=8)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select("ref", "clips", "text", F.when(F.col("samples").isNotNull(), F.size("samples")).cast("bigint").alias("samples_n"), F.round(total, 6).alias("total"),
                       F.array_join("warnings", ",").alias("warnings"), "error")


@query("src7_read_clips", f"""WITH {SIGNAL}, m AS (SELECT vec_id, CASE WHEN channels = 1 THEN s ELSE list_transform(range(0, len(s) // 2), lambda k: (s[2 * k + 1] + s[2 * k + 2]) / 2) END AS mono FROM loud)
SELECT vec_id, len(mono)::BIGINT AS frames, list_max(mono) AS top FROM m""")
def src7_read_clips(spark, d):
    """Clips written and read back; interleaved channels folded to mono."""
    path = workspace(spark)
    signal(spark, d).select(F.col("vec_id").alias("clip_id"), F.lit(8).alias("rate"), F.col("channels").cast("int").alias("channels"), F.col("loud").cast("array<float>").alias("samples")).write.parquet(path)
    clips = readers.read_clips(spark, path).filter(F.coalesce("error", F.lit("")) != "no rate or channels").withColumnsRenamed({"clip_id": "vec_id", "samples": "loud"})
    folded = clips.select("vec_id", ql.mono(F.col("loud"), F.col("channels")).alias("mono"))
    return folded.select("vec_id", F.size("mono").cast("bigint").alias("frames"), F.array_max("mono").alias("top"))
