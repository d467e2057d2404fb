"""Chat formatting: each dialogue once from the perspective of every participant.

In a participant's rendering their turns are the assistant's and are trained on; everybody else is a named user. Renderings are
tables of turns with offsets, not strings, so a dialogue of any length stays spread over the cluster; joining the texts of a
rendering in turn order gives the string. Built of DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running


@dataclass(frozen=True)
class Template:
    """Fixed strings around a turn. System turns belong to nobody: they are no participant and look alike in all renderings."""

    assistant: str = "<|assistant|>\n"
    user: str = "<|user name={name}|>\n"
    system: str = "<|system|>\n"
    end: str = "<|end|>\n"
    system_role: str = "system"


def rotate(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, turn, seat, rendered, start, length, mask_start, mask_length``: a row per perspective and turn.

    ``start`` and ``length`` place the turn in its rendering (code points). ``mask_start`` and ``mask_length`` place what is trained on: text and
    end mark of the participant's own turns, else length 0 at the turn's end. ``seat`` is assistant, user or system.

    A null text is empty, a null speaker is a participant with an empty name. Turns without number come first; turns that share
    one are ordered by speaker and text, and rows that repeat in everything by nothing that could be told apart. Rows without dialogue
    id form one dialogue. A dialogue of system turns alone has no participant and gives no row. Marks inside a text or a name
    are broken up with a zero-width space after ``<|``.
    """
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("<​|"))

    said = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), F.coalesce(turns[speaker].cast("string"), F.lit("")).alias("speaker"),
                        plain(F.coalesce(turns[text], F.lit(""))).alias("text"))
    people = said.filter(F.col("speaker") != template.system_role).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    # both sides meet on the dialogue; the side of the turns may be split where a dialogue is large
    seen = said.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    seat = (F.when(F.col("speaker") == template.system_role, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user"))
    before, after = template.user.split("{name}")
    head = (F.when(F.col("seat") == "system", template.system).when(F.col("seat") == "assistant", template.assistant)
            .otherwise(F.concat(F.lit(before), plain(F.col("speaker")), F.lit(after))))
    shown = (seen.withColumn("seat", seat).withColumn("_head", head).withColumn("rendered", F.concat("_head", "text", F.lit(template.end)))
             .select("conv_id", "perspective", "turn", "speaker", "text", "seat", "rendered", F.length("_head").cast("long").alias("_head"), F.length("rendered").cast("long").alias("length")))
    placed = running(shown, ["conv_id", "perspective"], ["turn", "speaker", "text"], {"_end": F.col("length")})
    own = F.col("seat") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "seat", "rendered", (F.col("_end") - F.col("length")).alias("start"), "length",
        F.when(own, F.col("_end") - F.col("length") + F.col("_head")).otherwise(F.col("_end")).alias("mask_start"),
        F.when(own, F.col("length") - F.col("_head")).otherwise(F.lit(0).cast("long")).alias("mask_length"))


SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT s.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = p.perspective THEN 'assistant' ELSE 'user' END AS seat
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
shown AS (
  SELECT *, CASE seat WHEN 'system' THEN '<|system|>' WHEN 'assistant' THEN '<|assistant|>'
    ELSE '<|user name=' || replace(speaker, '<|', '<' || chr(8203) || '|') || '|>' END || chr(10) AS head FROM seen),
whole AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM shown),
placed AS (SELECT *, length(rendered) AS n, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS last FROM whole)
SELECT conv_id, perspective, turn, seat, rendered, (last - n)::BIGINT AS start, n AS length,
  (CASE WHEN seat = 'assistant' THEN last - n + length(head) ELSE last END)::BIGINT AS mask_start,
  (CASE WHEN seat = 'assistant' THEN n - length(head) ELSE 0 END)::BIGINT AS mask_length
FROM placed
"""
