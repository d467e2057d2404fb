"""Incremental twins of the batch operators on Structured Streaming.

Sources are streaming DataFrames; every function returns a streaming DataFrame, and ``drain`` runs one to the end of its
input into a table. The state of each query is keyed and lives in the state store, so it is partitioned like a shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators import clean as cl
from ..operators import rollup, select
from ..operators import segment as sg
from ..operators.scan import position, running
from ..session import workspace
from ..sources import store as st


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet table, a folder of part files or one file, as a stream of files. A table that does not exist is an error."""
    path = f"{folder}/{name}.parquet"
    found = spark.read.parquet(path)
    files = found.select("_metadata.file_path").limit(1).collect()
    whole = not files or not files[0][0].rstrip("/").endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def arrivals(rows: DataFrame, slices: Column, number: int, files: int | None = None) -> DataFrame:
    """A table as a stream that arrives in ``number`` slices, one a trigger, those with slice 0 first. Each is written on its own, in as many
    ``files`` as a trigger takes (``spark.sql.shuffle.partitions`` by default)."""
    spark, path = rows.sparkSession, workspace(rows.sparkSession)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(number):
        rows.filter(slices == k).repartition(files).write.parquet(f"{path}/slice={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process everything available and return the result.

    Appended rows go to a parquet sink. In update mode each trigger's rows are written with their trigger number, and
    the last version per key is the result.
    """
    spark = stream.sparkSession
    path, marks = workspace(spark), workspace(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        def save(batch: DataFrame, number: int) -> None:
            # the folder is named by the trigger, so a retried trigger replaces its own output
            batch.write.mode("overwrite").parquet(f"{path}/_trigger={number}")
        writer = stream.writeStream.foreachBatch(save)
    query = writer.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = stream.schema
    if mode == "append":
        return spark.read.schema(fields).parquet(path)
    rows = spark.read.schema(T.StructType([*fields, T.StructField("_trigger", T.LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_trigger").alias("_v"))
    return latest.select(*keys, "_v.*")


def stream_segments(docs: DataFrame, *keys: str, rules: cl.CleanRules = cl.CleanRules()) -> DataFrame:
    """New documents as cleaned segments; stateless, so a restart resumes from the source's checkpoint alone."""
    return sg.segment_exact(cl.clean(docs, rules), *keys)


def stream_latest_state(log: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """The newest record per key as a streaming aggregate (update mode)."""
    return st.newest(keys, stamp)(log)


def latest_store(spark: SparkSession, path: str, log: DataFrame, keys: list[str], stamp: list[str], **options) -> st.KeyedStore:
    """A table of the newest record per key, which a stream is fed into trigger by trigger; no trigger looks at older history than that."""
    return st.KeyedStore(spark, path, log.schema, tuple(keys), st.newest(keys, stamp), **options)


def stream_dedupe_ids(items: DataFrame, key: str, stamp: str | None = None, delay: str = "1 hour", late: str | None = None) -> DataFrame:
    """Each id once. Without ``stamp`` ids are remembered for good.

    With it, an id counts again after a gap longer than ``delay``: ``key, first_seen, last_seen, occurrences``, a row for each stretch of
    occurrences no further apart. A stretch is given out when the watermark, ``late`` behind the newest row (``delay`` if not said), has
    passed its end by ``delay``; then its state is dropped. Rows that arrive later than that are left out.
    """
    if stamp is None:
        return items.dropDuplicates([key])
    timed = items.withColumn("_event_time", F.col(stamp).cast("timestamp")).withWatermark("_event_time", late or delay)
    return _stretches(timed, key, delay)


def dedupe_ids_batch(items: DataFrame, key: str, stamp: str, delay: str = "1 hour") -> DataFrame:
    """The same from a complete table, with the stretches a stream would still hold."""
    return _stretches(items.withColumn("_event_time", F.col(stamp).cast("timestamp")), key, delay)


def _stretches(timed: DataFrame, key: str, delay: str) -> DataFrame:
    return timed.groupBy(key, F.session_window("_event_time", delay).alias("_w")).agg(
        F.min("_event_time").alias("first_seen"), F.max("_event_time").alias("last_seen"), F.count("*").alias("occurrences")).drop("_w")


def stream_progress(records: DataFrame, *keys: str) -> DataFrame:
    """Cumulative counts and sums per key, emitted each trigger (update mode); see ``progress_ratios``."""
    done = F.col("status") == "completed"
    return records.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        F.coalesce(F.sum(F.when(done, F.col("chars"))), F.lit(0)).alias("generated_chars"),
        F.coalesce(F.sum(F.when(~done, F.col("chars"))), F.lit(0)).alias("remaining_chars"),
        F.sum("generation_seconds").alias("generation_seconds"), F.sum("duration").alias("audio_seconds"))


def progress_ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumn("rtf", rollup.ratio(F.col("generation_seconds"), F.col("audio_seconds")))


MEASURES = ("generated", "generated_chars", "generation_seconds", "audio_seconds", "elapsed_seconds")


def progress_store(spark: SparkSession, path: str, records: DataFrame, keys: list[str], key: str = "segment_id", **options) -> st.KeyedStore:
    """What a run has done so far, by identity; see ``outcomes``. Sums only, so a trigger costs what it brings."""
    return st.KeyedStore(spark, path, outcomes(records, keys, key).schema, (*keys, key), st.totals([*keys, key]), **options)


def outcomes(records: DataFrame, keys: list[str], key: str = "segment_id") -> DataFrame:
    """Rows of a run, ``keys, segment_id, status, chars, generation_seconds, duration, elapsed_seconds``, as measures that can be added up.
    ``elapsed_seconds`` is what each row adds to the clock of its run."""
    done = F.col("status") == "completed"
    return records.select(*keys, key, done.cast("bigint").alias("generated"), F.when(done, F.col("chars")).otherwise(0).cast("bigint").alias("generated_chars"),
                          F.col("generation_seconds").cast("double").alias("generation_seconds"), F.col("duration").cast("double").alias("audio_seconds"),
                          F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"))


def live_progress(progress: DataFrame, plan: DataFrame, keys: list[str], key: str = "segment_id") -> DataFrame:
    """Progress with remaining time, rates and weights by occurrence in the plan (``keys, segment_id, chars``), from a ``progress_store``; what
    ``rollup.progress_metrics`` gives for the finished run."""
    finished = progress.filter(F.col("generated") > 0).select(*keys, key)
    runs = progress.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return rollup.progress_metrics(plan, finished, runs, *keys, key=key)


SPENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("epoch", T.IntegerType()), T.StructField("seq", T.LongType())])
BUDGET = T.StructType([T.StructField("id", T.LongType()), T.StructField("policy", T.StringType()), T.StructField("failures", T.IntegerType()),
                       T.StructField("epoch", T.IntegerType()), T.StructField("seq", T.LongType())])


def budget_store(spark: SparkSession, path: str, keep_after: int | None = None, **options) -> st.KeyedStore:
    """Failures, policy and epoch of each id. ``keep_after``: ids whose last row has a smaller ``seq`` are forgotten when their bucket is written."""
    keep = F.col("seq") >= keep_after if keep_after is not None else None
    return st.KeyedStore(spark, path, BUDGET, ("id",), st.newest(["id"], ["seq"]), keep=keep, **options)


def retry_budget(attempts: DataFrame, store: st.KeyedStore, path: str, marks: str, limit: int = fixed.MAX_RETRY + 1) -> DataFrame:
    """Exhausted ids of a stream ``id, seq, kind, policy`` whose rows arrive in ``seq`` order between triggers, each reported once.

    A success, a retry request or a changed policy resets the count. A trigger is a batch job over its rows and the stored
    budgets of their ids: an id of any number of rows is spread over tasks. Runs until the input is used up.
    """
    spark = attempts.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        if number > store.last():
            spent, budgets = spend(batch, store.read(), limit)
            spent.write.mode("overwrite").parquet(f"{path}/trigger={number}")  # a repeated trigger replaces its own answers
            store.merge(budgets, number)

    attempts.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(SPENT).parquet(path).select(*SPENT.names)
    except AnalysisException:  # no trigger ran
        return spark.createDataFrame([], SPENT)


def spend(attempts: DataFrame, budgets: DataFrame, limit: int, **scan) -> tuple[DataFrame, DataFrame]:
    """Exhaustions among ``attempts``, given the budgets before them; and the budgets after."""
    # A stored budget stands in as the failures that led to it: one row, before all others.
    known = budgets.join(attempts.select("id").distinct(), "id", "left_semi")
    first = known.select("id", F.lit(None).cast("long").alias("seq"), F.lit("stored").alias("kind"), "policy", "failures", "epoch")
    rows = first.unionByName(attempts.select("id", "seq", "kind", "policy", F.lit(0).alias("failures"), F.lit(0).alias("epoch")))
    counted = counted_failures(rows.withColumn("_order", F.coalesce("seq", F.lit(-(1 << 62)))), "_order", **scan)
    spent = counted.filter((F.col("kind") == "failed") & (F.col("_n") == limit)).select("id", F.col("epoch").cast("int").alias("epoch"), "seq")
    last = counted.filter(F.col("kind") != "stored").groupBy("id").agg(F.max_by(F.struct("policy", "_n", "epoch", "seq"), "seq").alias("r"))
    return spent, last.select("id", "r.policy", F.col("r._n").cast("int").alias("failures"), F.col("r.epoch").cast("int").alias("epoch"), "r.seq")


def counted_failures(rows: DataFrame, order: str, **scan) -> DataFrame:
    """``epoch`` and failures within it (``_n``) at every row of ``id, kind, policy, failures, epoch``. Rows of kind ``stored`` bring both along."""
    numbered = position(rows, ["id"], [order], "_at", **scan)
    # The previous policy comes from a join on the position, which is unique, so a long log of one id does not pile up.
    before = numbered.select("id", (F.col("_at") + 1).alias("_at"), F.col("policy").alias("_previous"))
    joined = numbered.join(before, ["id", "_at"], "left")
    changed = F.coalesce(F.col("_previous") != F.col("policy"), F.lit(False))
    failed, stored = F.col("kind") == "failed", F.col("kind") == "stored"
    reset = F.when(stored, F.col("epoch")).otherwise((~failed | changed).cast("bigint")).cast("bigint")
    marked = joined.withColumn("_reset", reset).withColumn("_failed", F.when(stored, F.col("failures")).otherwise(failed.cast("int")).cast("bigint")).drop("epoch")
    epochs = running(marked, ["id"], [order], {"epoch": F.col("_reset")}, **scan)
    return running(epochs, ["id", "epoch"], [order], {"_n": F.col("_failed")}, **scan)


def retry_budget_batch(attempts: DataFrame, limit: int = fixed.MAX_RETRY + 1, **scan) -> DataFrame:
    """The same from a complete log."""
    rows = attempts.select("id", "seq", "kind", "policy", F.lit(0).alias("failures"), F.lit(0).alias("epoch"))
    counted = counted_failures(rows, "seq", **scan)
    return counted.filter((F.col("kind") == "failed") & (F.col("_n") == limit)).select("id", F.col("epoch").cast("int").alias("epoch"), "seq")


def stale_events(receipts: DataFrame, jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """Receipts of the current attempt only: a stream joined with the job table, which is read anew each trigger."""
    return select.current_receipts(jobs, receipts, job)
