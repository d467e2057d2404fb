"""Segment identities, manifests signatures and artifact checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import identity as idf
from ..functions import text as tx


def identify_segments(segments: DataFrame, generation: str, title: str = "title", text: str = "text",
                      spoken: str | None = None, base_seed: int = fixed.BASE_SEED) -> DataFrame:
    """Add ``seed``, ``segment_id`` and ``text_hash``; batch size is no part of an identity."""
    heard = F.coalesce(F.col(spoken), F.col(text)) if spoken else F.col(text)
    return (segments.withColumn("seed", idf.segment_seed(heard, F.col(title), base_seed))
            .withColumn("segment_id", idf.segment_id(heard, F.col("seed"), generation))
            .withColumn("text_hash", idf.digest_string(F.col(text))))


def occurrences(segments: DataFrame, *scope: str, key: str = "segment_id") -> DataFrame:
    """Each identity once, with how often it stands in the plan. Map-side combined, so a hot identity is cheap."""
    return segments.groupBy(*scope, key).agg(F.count("*").alias("occurrences"))


def policy_hash(quality: dict, recognizer: str | None = None) -> str:
    """Identity of the acceptance policy; fields that only steer execution are left out."""
    kept = {k: v for k, v in quality.items() if k not in fixed.POLICY_EXECUTION_FIELDS}
    return idf.digest_literal({"qc_version": 1, "quality": kept, "asr_model": recognizer})


def manifest_signature(source: Column, settings: Column, generation: Column, selection: Column,
                       neutral: dict[str, str]) -> Column:
    """Digest of source, settings, generator and selection.

    ``settings`` is ``map<string,string>`` with dotted keys and JSON values. ``tts.batch_size`` never counts, and a key at
    its neutral value counts as absent, so adding a setting does not invalidate earlier runs.
    """
    defaults = F.create_map(*[F.lit(x) for pair in neutral.items() for x in pair]) if neutral else None

    def counts(key: Column, value: Column) -> Column:
        keep = key != "tts.batch_size"
        return keep if defaults is None else keep & ~value.eqNullSafe(F.try_element_at(defaults, key))

    kept = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(settings, counts))))
    base = dict(config=kept, generator=generation, source=source)
    return F.when(selection.isNull() | (F.size(selection) == 0), idf.digest(**base)).otherwise(
        idf.digest(**base, chapter_selection=F.array_sort(selection)))


def render_fingerprint(segments: DataFrame, chapter: list[str], title: Column, settings: str,
                       order: str = "seg_index") -> DataFrame:
    """Digest over the ordered (id, content hash, boundary) of one chapter, its title and the delivery settings.

    One chapter's segments come from one text cell, so the collected group is bounded by the cell.
    """
    grouped = segments.groupBy(*chapter).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), "segment_id", "content_sha256", "boundary"))).alias("_all"),
        F.first(title).alias("_title"))
    entries = F.transform("_all", lambda s: F.array(s["segment_id"], s["content_sha256"], s["boundary"]))
    return grouped.select(*chapter, idf.digest(audio_version=F.lit(1), output=F.lit(settings), segments=entries,
                                               title=F.col("_title")).alias("fingerprint"))


def artifact_valid(recorded: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """Per artifact: fingerprints agree, the file sets agree, and every stored hash equals the current one.

    ``recorded``/``current``: ``keys, path, fingerprint, sha256``.
    """
    old = recorded.select(*keys, "path", F.col("fingerprint").alias("_of"), F.col("sha256").alias("_os"))
    new = current.select(*keys, "path", F.col("fingerprint").alias("_nf"), F.col("sha256").alias("_ns"))
    same = F.col("_of").eqNullSafe(F.col("_nf")) & F.col("_os").eqNullSafe(F.col("_ns"))
    return (old.join(new, [*keys, "path"], "full_outer").groupBy(*keys)
            .agg(F.bool_and(same).alias("valid"), F.count("*").alias("files")))


def book_id(path: Column, stem: Column) -> Column:
    return F.concat(tx.safe_name(stem, 40), F.lit("-"), F.left(idf.digest_string(path), F.lit(10)))


def plan_signature(files: DataFrame, job: str, file: str, *settings: str, limit: int = fixed.DOWNLOAD_JOBS) -> DataFrame:
    """One digest per plan from its sorted distinct file ids and settings; detects stale plans.

    A plan of more than ``limit`` files has no signature, and ``files_n`` one more than the limit. No more ids than that are gathered; the rank
    filter runs before the shuffle too.
    """
    keys = [job, *settings]
    distinct = files.select(*keys, file).distinct()
    near = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(file))).filter(F.col("_r") <= limit + 1)
    ids = near.groupBy(*keys).agg(F.sort_array(F.collect_list(file)).alias("files"))
    signature = idf.digest(files=F.col("files"), **{s: F.col(s) for s in settings})
    return ids.select(job, F.size("files").alias("files_n"), F.when(F.size("files") <= limit, signature).alias("signature"))
