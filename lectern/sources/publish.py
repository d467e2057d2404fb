"""Publication of runs: exports and manifests that readers see whole or not at all.

Rows of a run are merged into keyed tables first; the run itself is entered last, and only entered runs count. So a run that is written
twice leaves one copy, one that dies half-way is not seen, and a new run leaves the exports of the one before in place, as earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, writers

SCHEMA_VERSION = 1
RUN = T.StructType([*(T.StructField(n, T.StringType()) for n in ("book_id", "signature", "source", "source_sha256", "title", "author", "model", "fingerprint", "settings", "status")),
                    T.StructField("started_at", T.TimestampType()), T.StructField("run_at", T.TimestampType()), T.StructField("total_chapters", T.LongType()),
                    T.StructField("selected_chapters", T.ArrayType(T.LongType())), T.StructField("generated", T.LongType()), T.StructField("cached", T.LongType()),
                    *(T.StructField(n, T.DoubleType()) for n in ("elapsed_seconds", "generation_seconds", "audio_seconds"))])
EXPORT = T.StructType([*(T.StructField(n, T.StringType()) for n in ("book_id", "signature", "kind", "format", "path", "sha256")),
                       T.StructField("chapter_index", T.LongType()), T.StructField("run_at", T.TimestampType())])


def fitted(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; those a table lacks are null, others are left out."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Publication:
    spark: SparkSession
    path: str

    @property
    def runs(self) -> store.KeyedStore:
        return store.KeyedStore(self.spark, f"{self.path}/runs", RUN, ("book_id", "signature"), store.newest(["book_id", "signature"], ["run_at"]))

    @property
    def exports(self) -> store.KeyedStore:
        keys = ["book_id", "signature", "path"]
        return store.KeyedStore(self.spark, f"{self.path}/exports", EXPORT, tuple(keys), store.newest(keys, ["run_at"]))

    def publish(self, runs: DataFrame, exports: DataFrame) -> None:
        """Exports, then the runs they belong to. May be repeated; of equal keys the newest ``run_at`` stands. Rows without a book or a signature are
        not published."""
        known = F.col("book_id").isNotNull() & F.col("signature").isNotNull()
        runs, exports = fitted(runs, RUN).filter(known), fitted(exports, EXPORT).filter(known & F.col("path").isNotNull())
        self.exports.merge(exports, self.exports.last() + 1)
        self.runs.merge(runs, self.runs.last() + 1)

    def located(self) -> DataFrame:
        """Every export of an entered run: ``EXPORT, current, location``. Current are those of a book's newest run."""
        runs = self.runs.read()
        entered = self.exports.read().join(runs.select("book_id", "signature"), ["book_id", "signature"], "left_semi")
        return writers.supersede(entered, runs, stamp=F.struct("run_at", "signature"))

    def manifests(self) -> DataFrame:
        """One document per book, of its newest run: run, status, scope of the selection, measures and exports. Chapters and segments are documents of
        their own (``writers.manifest_rows``), so none grows with the length of a book; exports are one per chapter and format."""
        keys = ["book_id"]
        newest = store.newest(keys, ["run_at", "signature"])(self.runs.read())
        shown = ("chapter_index", "kind", "format", "path", "sha256")
        listed = (self.located().filter("current").groupBy("book_id")
                  .agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("exports")))
        selected = F.size("selected_chapters")
        whole = F.coalesce(selected == F.col("total_chapters"), F.lit(False))
        empty = F.array().cast(T.ArrayType(T.StructType([EXPORT[n] for n in shown])))
        rate = F.try_divide(F.col("generation_seconds"), F.nullif(F.col("audio_seconds"), F.lit(0.0)))
        return (newest.join(listed, keys, "left").withColumn("exports", F.coalesce("exports", empty))
                .withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("complete_book", whole)
                .withColumn("export_scope", F.when(whole, "complete_book").otherwise("selected_chapters")).withColumn("rtf", rate))

