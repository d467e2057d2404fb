"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, secrets, packing.

Every stage works on all that the stage before it kept. Rows stay apart, whether or not they have an id or share it; only decontamination
decides by ``doc_id``, and keeps rows that have none.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import contamination
from lectern.llm.language import UNDETERMINED, fit, identify
from lectern.llm.minhash import Near, near_duplicates
from lectern.llm.packing import pack
from lectern.llm.secrets import redact
from lectern.llm.tables import fresh
from lectern.session import stable

VOCABULARY = "byte_bpe_50k.json"
BATCH_ROWS = 500  # documents in one Arrow batch; texts travel in both directions here
ORACLE_SQL = None  # none of the stages can be said in SQL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those without any letter are rejected. A missing label is filled in."""
    said, sure = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = identify(docs, fit(docs), keep=tuple(docs.columns), names=(said, sure)).filter(F.col(said) != UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", said)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that reach each other over similarities of 0.8 on five-word shingles, the row with the smallest id stays; of rows with
    equal ids, or without one, the first. Rows are compared by numbers that are written with them, so ids may repeat or be missing."""
    row = fresh("row", docs.columns)
    numbered = stable(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(numbered, Near(words=5, percent=80), id_col=row).filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    ids = numbered.select(F.col(row).alias("_row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("_place"))
    placed = groups.join(ids, "_row")
    first = placed.groupBy("component_id").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    gone = placed.join(first, "component_id").filter("_place != _first").select(F.col("_row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of a benchmark item go."""
    leaks = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; the documents stay."""
    return redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


def sized(stage):
    """The stage in a session whose Arrow batches are small; this job owns its session's settings."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(stage.__name__, sized(stage)) for stage in (language, deduplicate, decontaminate, remove_secrets, pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
