"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workspace
from . import chat, extraction, linkgraph, search, secrets
from .decontaminate import contamination
from .language import fit, identify
from .lm import score
from .minhash import Near, near_duplicates
from .packing import pack
from .records import read_records, write_records
from .registry import ORACLES, QUERIES, table
from .repetition import repetition
from .whitening import whiten

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "byte_bpe_50k.json"


def query(function):
    QUERIES[function.__name__] = function
    return function


def remainder(id_col: str, folds: int) -> Column:
    """The fold of a document; one without id counts as an empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


@query
def op6_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


@query
def op9_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


@query
def op2_spaced_seed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", remainder("doc_id", 5).alias("fold"))
    predicted = identify(docs, fit(docs.filter("fold != 0")), keep=("doc_id", "fold"))
    return predicted.select("doc_id", (F.col("fold") == 0).alias("held_out"), "lang_pred", "score")


@query
def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"), "n_random")


@query
def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(table(spark, sf_dir, "documents"), workspace(spark), public_tokenizers.path(VOCABULARY), end_id=0)
    return read_records(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query
def op10_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.filter_urls(table(spark, sf_dir, "pages"))


ORACLES["op3_perspective_rotation"] = chat.SQL
ORACLES["op10_link_graph_filter"] = linkgraph.sql()


@query
def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, remainder("doc_id", 7) != 2, public_tokenizers.path(VOCABULARY))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_principal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_geometric_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_geometric_block_search"] = search.SQL


@query
def op11_tree_marginals_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))
