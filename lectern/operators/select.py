"""Selections over jobs, files and exports: joins, validation and soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.identity import digest_string
from ..session import stable
from .quality import within_rate


_STEPS = "//|(^|/)[.]{1,2}(/|$)|/$"  # what makes a path more than the names in it


def confined(path: Column, folder: Column) -> Column:
    """``path`` below ``folder``, without ``.``, ``..`` and doubled slashes; null if it is not below it. A relative path is relative to the folder.

    Most paths are names alone, and a comparison of strings settles them; only the others are taken apart step by step. Either is bound to a
    variable: written out wherever it is used, what a path is made of gives code too long for the JVM to compile.
    """
    def judged(place: Column) -> Column:
        own, root = place["p"], place["f"]
        names = ~own.rlike(_STEPS) & (own != "")
        under = F.concat(root, F.lit("/"))
        beside = F.when(own.startswith(under), F.substring(own, F.length(under) + 1, F.length(own)))
        plain_folder = root.startswith("/") & ~root.rlike(_STEPS)
        return F.when(names & ~own.startswith("/"), own).when(names & plain_folder, beside).otherwise(_confined_steps(own, root))

    return tx.let(F.struct(path.alias("p"), folder.alias("f")), judged)


def _confined_steps(path: Column, folder: Column) -> Column:
    def resolved(value: Column) -> Column:
        steps = F.filter(F.split(value, "/"), lambda p: ~p.isin("", "."))
        return F.aggregate(steps, F.array().cast("array<string>"), lambda done, p: F.when(p != "..", F.concat(done, F.array(p)))
                           .when((F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
                           .when(value.startswith("/"), done).otherwise(F.concat(done, F.array(p))))

    own, root = resolved(path), resolved(folder)
    inside = path.startswith("/") & (F.slice(own, F.lit(1), F.size(root)) == root) & (F.size(own) > F.size(root))
    below = ~path.startswith("/") & (F.size(own) > 0) & (F.coalesce(F.get(own, 0), F.lit("..")) != "..")
    rest = F.when(inside, F.slice(own, F.size(root) + 1, F.size(own))).when(below, own)
    return F.array_join(rest, "/")


def media_records(exports: DataFrame, chapters: DataFrame, files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Registered exports and possible chapter renderings that exist inside the job's output folder, by their path below it.

    ``exports``: ``job_id, path, format``; ``chapters``: ``job_id, title, stem``; ``files``: ``job_id, path`` present; ``folders``: ``job_id, folder``, one
    row per job. Without ``folders`` (or for a job it does not list) paths have to be relative. Paths that lead out of the folder are left out.
    """
    def held(rows: DataFrame, column: str) -> DataFrame:
        if folders is not None:
            rows = rows.join(folders.select("job_id", F.col("folder").alias("_folder")), "job_id", "left")
        root = F.coalesce("_folder", F.lit("/..")) if folders is not None else F.lit("/..")
        inner = F.when(F.col(column).startswith("/") & (root == "/.."), F.lit(None)).otherwise(confined(F.col(column), root))
        return rows.withColumn(column, inner).filter(F.col(column).isNotNull()).drop("_folder")

    exports, chapters, files = held(exports, "path"), held(chapters, "stem"), held(files, "path").select("job_id", "path").distinct()
    registered = exports.select("job_id", "path", "format", F.lit(None).cast("string").alias("chapter")).join(files, ["job_id", "path"], "left_semi")
    # A chapter has one possible file per format. Joining on the stem finds the existing ones without listing them all.
    ending = F.substring_index("path", ".", -1)
    stems = files.filter(ending.isin(fixed.MEDIA_FORMATS)).select(
        "job_id", ending.alias("format"), F.left("path", F.length("path") - F.length(ending) - 1).alias("stem")).distinct()
    rendered = chapters.join(stems, ["job_id", "stem"])
    found = registered.unionByName(rendered.select("job_id", F.concat_ws(".", "stem", "format").alias("path"), "format", F.col("title").alias("chapter")))
    suffix = F.lower(F.substring_index("path", ".", -1))
    return (found.filter(suffix.isin(fixed.MEDIA_SUFFIXES)).withColumn("media_id", F.left(digest_string(F.col("path")), F.lit(20)))
            .withColumn("format", F.coalesce("format", suffix)))


def download_selection(requests: DataFrame, jobs: DataFrame, media: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """Files of each bundle request in its format, once per media id, with an error where the request is not allowed.

    ``requests``: ``bundle_id, job_id, format``; ``jobs``: ``job_id, status, kind``; ``media``: ``job_id, media_id, path, format``.
    """
    wanted = requests.dropDuplicates([bundle, "job_id"])
    size = wanted.groupBy(bundle).agg(F.count("*").alias("_jobs"))
    # media rows are unique per (job, id) before the join, so no window is needed to drop repeats
    unique = media.withColumn("_suffix", F.lower(F.substring_index("path", ".", -1))).groupBy("job_id", "media_id", "_suffix").agg(F.min("path").alias("path"))
    joined = (wanted.join(size, bundle).join(jobs.select("job_id", "status", "kind", F.lit(True).alias("_known")), "job_id", "left")
              .join(unique.withColumnRenamed("_suffix", "format"), ["job_id", "format"], "left"))
    error = (F.when(F.col("_jobs") > fixed.DOWNLOAD_JOBS, "too_many_jobs").when(F.col("_known").isNull(), "unknown_job")
             .when((F.col("status") != "completed") | (F.coalesce("kind", F.lit("convert")) == "reference"), "not_completed")
             .when(F.col("media_id").isNull(), "no_export"))
    named = F.concat(F.lit("task_"), tx.safe_name(F.col("job_id").cast("string")), F.lit("/"), F.col("path"))
    # The selected rows are few against the media they come from; written once, the bundle totals do not search them again.
    rows = stable(joined.withColumn("error", error).withColumn("archive_name", F.when(F.col("error").isNull(), named))
                  .select(bundle, "job_id", "media_id", "archive_name", "error"))
    counts = rows.groupBy(bundle).agg(F.count("media_id").alias("files"), F.min("error").alias("bundle_error"))
    return (rows.join(counts, bundle)
            .withColumn("bundle_error", F.when(F.col("files") > fixed.DOWNLOAD_FILES, "too_many_files").otherwise(F.col("bundle_error")))
            .select(bundle, "job_id", "media_id", "archive_name", "error", "bundle_error"))


def collectable(jobs: DataFrame, submitted: DataFrame, activated: Column, fmt: str, limit: int = fixed.DOWNLOAD_JOBS, media: DataFrame | None = None) -> DataFrame:
    """Finished conversions not yet submitted nor archived, while no job is active or queued. Key: job, format, finish.

    With ``media`` (``job_id, format``) only jobs that have a file in the format.
    """
    key = F.concat_ws(":", F.col("job_id").cast("string"), F.lit(fmt), F.coalesce("finished_at", "created_at").cast("string"))
    idle = jobs.filter(F.col("status").isin([*fixed.ACTIVE_STATUSES, "queued"])).agg(F.count("*") == 0)
    ready = jobs.filter((F.col("status") == "completed") & (F.coalesce("kind", F.lit("convert")) == "convert")
                        & (F.col("finished_at") >= activated)).withColumn("download_key", key)
    if "archived" in jobs.columns:
        ready = ready.filter(~F.coalesce("archived", F.lit(False)))
    if media is not None:
        ready = ready.join(media.filter(F.lower("format") == fmt.lower()).select("job_id").distinct(), "job_id", "left_semi")
    fresh = ready.join(submitted.select("download_key").distinct(), "download_key", "left_anti")
    return (fresh.filter(idle.scalar())
            .orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit))


def visible(records: DataFrame, name: str, query: str, group: str = "all", show_archived: bool = False) -> DataFrame:
    """Case-insensitive search with archive and status-group filters; a pure filter."""
    groups = {"queued": ["queued"], "active": fixed.ACTIVE_STATUSES, "finished": fixed.TERMINAL_STATUSES}
    df = records.filter(F.lower(name).contains(query.strip().lower()))
    if not show_archived and "archived" in records.columns:
        df = df.filter(~F.coalesce("archived", F.lit(False)))
    return df if group == "all" else df.filter(F.col("status").isin(groups[group]))


def validate_ids(requests: DataFrame, known: DataFrame, request: str, key: str, limit: int = fixed.REQUEST_LIMIT,
                 duplicates_fail: bool = False) -> DataFrame:
    """All-or-nothing check per request: how many ids, how many unknown or repeated, and the resulting error."""
    each = requests.groupBy(request, key).agg(F.count("*").alias("_n"))
    marked = each.join(known.select(key, F.lit(True).alias("_known")), key, "left")
    totals = marked.groupBy(request).agg(
        F.count("*").alias("ids"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.count_if(F.col("_n") > 1).alias("repeated"))
    error = F.when(F.col("ids") > limit, "too_many").when(F.col("unknown") > 0, "unknown")
    if duplicates_fail:
        error = error.when(F.col("repeated") > 0, "duplicate")
    return totals.withColumn("error", error)


def archive(records: DataFrame, ids: DataFrame, key: str, archived: bool = True) -> DataFrame:
    """Set or clear the soft-delete flag of the listed records."""
    flags = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    current = F.coalesce("archived", F.lit(False))
    return (records.join(flags, key, "left")
            .withColumn("archived", F.when(F.col("_hit"), F.lit(archived)).otherwise(current)).drop("_hit"))


def restore(records: DataFrame, ids: DataFrame, key: str, name: str, stamp: str) -> DataFrame:
    """Restore profiles; of each case-folded name the restored (newest) one stays active and the others are archived."""
    flags = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    marked = records.join(flags, key, "left").withColumn("_name", F.lower(name))
    winners = marked.filter("_hit").groupBy("_name").agg(F.max_by(key, F.struct(stamp, key)).alias("_winner"))
    joined = marked.join(winners, "_name", "left")
    return (joined.withColumn("archived", F.when(F.col("_winner").isNull(), F.coalesce("archived", F.lit(False)))
                              .otherwise(F.col(key) != F.col("_winner"))).drop("_hit", "_name", "_winner"))


def hidden_filter(tasks: DataFrame, removed: DataFrame, key: str, include_removed: bool = False) -> DataFrame:
    return tasks if include_removed else tasks.join(removed.select(key).distinct(), key, "left_anti")


def current_receipts(jobs: DataFrame, receipts: DataFrame, job: str = "job_id") -> DataFrame:
    """Receipts of the job's own attempt written since it started."""
    facts = jobs.select(job, F.col("attempt_id").alias("_attempt"), "started_at")
    return (receipts.join(facts, job)
            .filter((F.col("attempt_id") == F.col("_attempt")) & (F.col("updated_at") >= F.col("started_at"))).drop("_attempt", "started_at"))


def recheck_transcripts(segments: DataFrame, transcripts: DataFrame | None, key: str, text: str = "text", heard: str = "transcript",
                        max_cer: float = fixed.MAX_CER) -> DataFrame:
    """Stored segments compared with new transcripts, which ``segments`` may hold already. Only whether the error rate is small enough is asked, so
    a comparison ends where the allowed distance is exceeded; ``distance`` and ``cer`` are null there."""
    joined = segments if transcripts is None else segments.join(transcripts, key)
    return within_rate(joined, text, heard, max_cer)
