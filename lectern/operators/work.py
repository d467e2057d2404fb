"""Batches, attempts and bounded retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import identity as idf
from ..session import stable, workspace


def plan_batches(items: DataFrame, chapter: list[str], order: str, chars: Column, size: int,
                 ratio: float = fixed.LENGTH_RATIO) -> DataFrame:
    """Batches of at most ``size`` items of one chapter whose lengths differ by at most ``ratio``.

    As in a look-ahead of four batches, only items of the same stretch of ``4 * size`` positions can share a batch. That
    also bounds every window group to ``4 * size`` rows, however long the chapter. ``order`` is unique in a chapter.
    """
    bucket = F.floor(F.log(F.greatest(chars, F.lit(1)).cast("double")) / F.log(F.lit(ratio)))
    stretch = F.floor((F.col(order) - 1) / (fixed.LOOKAHEAD * size))
    marked = items.withColumn("stretch", stretch.cast("bigint")).withColumn("length_bucket", bucket.cast("bigint"))
    window = Window.partitionBy(*chapter, "stretch", "length_bucket").orderBy(order)
    return marked.withColumn("batch_no", F.floor((F.row_number().over(window) - 1) / size).cast("bigint"))


BATCH_KEY = ["stretch", "length_bucket", "batch_no"]


def batch_identity(batched: DataFrame, batch: list[str], order: str, text: str = "text", seed: str = "seed") -> DataFrame:
    """Digest of the ordered (text, seed) list, and the seed a batch runs with. Groups are at most one batch."""
    grouped = batched.groupBy(*batch).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(seed).alias("s")))).alias("_m"))
    pairs = F.array_join(F.transform("_m", lambda m: F.concat(
        F.lit("["), F.regexp_extract(F.to_json(F.array(m["t"])), r"(?s)^\[(.*)\]$", 1), F.lit(","),
        m["s"].cast("string"), F.lit("]"))), ",")
    keyed = grouped.withColumn("batch_id", F.sha2(F.concat(F.lit("["), pairs, F.lit("]")), 256))
    own = F.get("_m", F.lit(0))["s"]
    shared = F.pmod(idf.hash_number(F.col("batch_id")), F.lit(fixed.SEED_MODULUS).cast("bigint"))
    return keyed.select(*batch, F.size("_m").alias("members"), "batch_id",
                        F.when(F.size("_m") == 1, own).otherwise(shared).alias("batch_seed"))


def amortize_metrics(results: DataFrame, batch: list[str], seconds: str, duration: str) -> DataFrame:
    """Each member's share of the batch time, and the batch's real-time factor. ``seconds`` is constant in a batch."""
    window = Window.partitionBy(*batch)
    return (results.withColumn("batch_size", F.count("*").over(window))
            .withColumn("batch_audio_seconds", F.sum(duration).over(window))
            .withColumn("generation_seconds", F.col(seconds) / F.col("batch_size"))
            .withColumn("rtf", F.col(seconds) / F.greatest(F.col("batch_audio_seconds"), F.lit(0.001))))


def initial_attempt(status: Column, attempts: Column, same_policy: Column, retry_failed: Column | bool = False) -> Column:
    """Attempts already spent: none for new, finished, retried or re-judged work; an unfinished attempt does not count."""
    retry = F.lit(retry_failed) if isinstance(retry_failed, bool) else retry_failed
    spent = F.coalesce(attempts, F.lit(0))
    fresh = status.isNull() | retry | (status == "completed") | ~F.coalesce(same_policy, F.lit(False))
    return F.when(fresh, 0).when(status.isin("running", "generated"), F.greatest(spent - 1, F.lit(0))).otherwise(spent)


def attempt_history(attempts: DataFrame, keys: list[str], order: list[str], fields: list[str],
                    limit: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """The last attempts per key, oldest first. The rank filter is applied before the shuffle as well."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    kept = attempts.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= limit)
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("history"))
    return grouped


def checkpoint_limit(pending: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` pending items in order."""
    return pending.orderBy(*order).limit(n)


RESULTS = {"double": float, "string": str}

Scorer = Callable[[list[str]], list[float] | list[str]]


def score_batches(batched: DataFrame, scorer: Scorer, batch: list[str], item: str, text: str = "text",
                  order: str | None = None, result: str = "double") -> DataFrame:
    """Run a user function over each batch: ``item_id, score, error, call_size``.

    It returns a number for each text, or with ``result="string"`` a text (a transcript, say).

    If it raises or returns the wrong number of results, the batch is halved until the faulty items stand alone; their
    error becomes a column and no other item is lost. Rows are clustered by batch and sorted, and a task walks its
    partition holding one batch at a time: no Python group is built per batch.
    """
    ordering, of_kind = order or item, RESULTS[result]

    def attempt(ids: list[str], texts: list[str]) -> list[tuple]:
        try:
            scores = list(scorer(texts))
            if len(scores) != len(texts):
                raise ValueError(f"expected {len(texts)} results, got {len(scores)}")
            return [(i, of_kind(s), None, len(ids)) for i, s in zip(ids, scores)]
        except Exception as exc:  # a faulty member must not take its batch down
            if len(ids) == 1:
                return [(ids[0], None, f"{type(exc).__name__}: {exc}", 1)]
            middle = len(ids) // 2
            return attempt(ids[:middle], texts[:middle]) + attempt(ids[middle:], texts[middle:])

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last batch of a chunk may continue in the next one
        for chunk in chunks:
            frame = chunk if rest is None else pd.concat([rest, chunk], ignore_index=True)
            if frame.empty:
                continue
            starts = np.flatnonzero(frame[batch].ne(frame[batch].shift()).any(axis=1).to_numpy())
            rest = frame.iloc[starts[-1]:]
            yield score(frame, starts, starts[-1])
        if rest is not None:
            yield score(rest.reset_index(drop=True), np.array([0]), len(rest))

    def score(frame: pd.DataFrame, starts: np.ndarray, end: int) -> pd.DataFrame:
        ids, texts = frame["item_id"].tolist(), frame["_text"].tolist()
        edges = [*starts[starts < end].tolist(), end]
        rows = [row for low, high in zip(edges, edges[1:]) for row in attempt(ids[low:high], texts[low:high])]
        return pd.DataFrame(rows, columns=["item_id", "score", "error", "call_size"])

    ready = batched.select(*batch, F.col(ordering).alias("_order"), F.col(item).cast("string").alias("item_id"), F.col(text).alias("_text"))
    return ready.repartition(*batch).sortWithinPartitions(*batch, "_order").mapInPandas(run, f"item_id string, score {result}, error string, call_size int")


Step = Callable[[DataFrame, int], DataFrame]


def retry_loop(items: DataFrame, step: Step, key: str, max_retry: int = fixed.MAX_RETRY, path: str | None = None, rounds: int | None = None) -> DataFrame:
    """Run ``step(pending, number of the round)`` until every item passes or its attempts are spent.

    ``pending`` has the items' columns and ``attempt``, from 0. ``step`` returns ``key, passed`` and any further columns. Rounds are events: each is
    written under ``path`` and entered when it is complete, and what is pending follows from the events alone. So a job that ends
    at any point and starts again with the same path goes on with the attempts that were spent and scores no finished item again, and items that were
    added meanwhile begin at 0. Keys are unique; items without one are left out. ``rounds``: stop after so many; what then is unsettled has the status ``pending``.

    Returns the last event of each item that has one: step's columns, ``attempts``, ``status``.
    """
    spark = items.sparkSession
    path = path or workspace(spark)
    items = items.filter(F.col(key).isNotNull())
    events = _events(spark, path)
    for _ in range(max_retry + 1 if rounds is None else min(rounds, max_retry + 1)):
        if events is None:
            pending = items.withColumn("attempt", F.lit(0))
        else:
            # who is pending is settled by the keys alone and written: where that is few, the items, which may hold long texts, stay where they are
            known = items.select(key).join(_spent(events, key), key, "left")
            spent, settled = F.coalesce("_attempts", F.lit(0)), F.coalesce("_passed", F.lit(False))
            again = stable(known.filter(~settled & (spent <= max_retry)).select(key, spent.cast("int").alias("attempt")))
            if again.isEmpty():
                break
            pending = items.join(again, key).select(*items.columns, "attempt")
        number = _rounds(spark, path)
        outcome = step(pending, number)
        if "attempt" not in outcome.columns:
            outcome = outcome.join(pending.select(key, "attempt"), key)
        outcome.write.mode("overwrite").parquet(f"{path}/events/round={number}")
        # entered last: a round without this row did not happen, and is written over
        spark.range(1).write.mode("overwrite").parquet(f"{path}/entered/round={number}")
        events = _events(spark, path)
    if events is None:
        raise ValueError("no round has been run")
    last = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), "attempt").alias("_e")).select(key, "_e.*")
    status = F.when(F.col("passed"), "completed").when(F.col("attempt") >= max_retry, "exhausted").otherwise("pending")
    return last.withColumn("attempts", F.col("attempt") + 1).withColumn("status", status).drop("attempt", "round")


def _rounds(spark: SparkSession, path: str) -> int:
    """Rounds that have been entered; they are numbered from 0."""
    try:
        return spark.read.schema("id long, round int").parquet(f"{path}/entered").count()
    except AnalysisException:  # none yet
        return 0


def _events(spark: SparkSession, path: str) -> DataFrame | None:
    entered = _rounds(spark, path)
    if not entered:
        return None
    return spark.read.option("basePath", f"{path}/events").parquet(*[f"{path}/events/round={k}" for k in range(entered)])


def _spent(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("_attempts"), F.bool_or("passed").alias("_passed"))
