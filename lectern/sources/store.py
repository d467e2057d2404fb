"""A keyed table that triggers and runs merge into: current values only, exactly once, never half written.

Rows are divided into buckets by a hash of their key. A bucket has two slots; a merge reads the current slots of the buckets it touches, writes
the other ones, and then publishes a small table that says which slot of each bucket is current and which trigger wrote it. A trigger that
is run again finds its number published and does nothing, or writes the same slots again. Superseded values are overwritten, so
the table holds two versions of a bucket at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Combine = Callable[[DataFrame], DataFrame]
POINTER = T.StructType([T.StructField(n, T.LongType()) for n in ("number", "bucket", "slot")])
ALL = -1  # a pointer row that stands for the trigger itself


def newest(keys: list[str], stamp: list[str]) -> Combine:
    """The row with the largest stamp of each key."""
    def combine(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*stamp)).alias("_r")).select(*keys, "_r.*")
    return combine


def totals(keys: list[str]) -> Combine:
    """Sums of every other column; null where all are."""
    def combine(rows: DataFrame) -> DataFrame:
        values = [f for f in rows.schema.fields if f.name not in keys]
        return rows.groupBy(*keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in values])
    return combine


@dataclass(frozen=True)
class KeyedStore:
    """``schema``: all columns of the table; ``keys``: those that identify a row. ``combine`` makes one row of several with equal keys, in any order and
    grouping. ``keep``: a condition; rows that fail it leave the table when their bucket is next written."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    combine: Combine
    buckets: int = 16
    keep: Column | None = None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("long")

    def _pointer(self) -> tuple[int, dict[int, int]]:
        """Number of the last published trigger (-1: none) and the current slot of each bucket; a row per bucket at most."""
        try:
            rows = self.spark.read.schema(T.StructType([*POINTER.fields, T.StructField("turn", T.IntegerType())])).parquet(f"{self.path}/pointer").collect()
        except AnalysisException:  # nothing has been published
            rows = []
        last = max((r["number"] for r in rows), default=-1)
        return last, {r["bucket"]: r["slot"] for r in rows if r["number"] == last and r["bucket"] != ALL}

    def _current(self, slots: dict[int, int], only: set[int] | None = None) -> DataFrame:
        wanted = {b: s for b, s in slots.items() if only is None or b in only}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        fields = T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("slot", T.LongType())])
        rows = self.spark.read.schema(fields).parquet(f"{self.path}/data")
        sides = [F.col("slot").eqNullSafe(s) & F.col("bucket").isin([b for b, own in wanted.items() if own == s]) for s in set(wanted.values())]
        return rows.filter(sides[0] if len(sides) == 1 else sides[0] | sides[1]).select(*self.schema.names)

    def last(self) -> int:
        """Number of the last trigger that was taken in, -1 before the first."""
        return self._pointer()[0]

    def read(self) -> DataFrame:
        """What is published now. A reader may go on while the next trigger writes; the one after that reuses its files."""
        return self._current(self._pointer()[1])

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Take in the rows of trigger ``number``; False if it had been taken in before. Numbers rise."""
        last, slots = self._pointer()
        if number <= last:
            return False
        new = self.combine(batch.select(*self.schema.names)).persist()
        try:
            touched = {r["bucket"] for r in new.select(self._bucket().alias("bucket")).distinct().collect()}
            if touched:
                merged = self.combine(new.select(*self.schema.names).unionByName(self._current(slots, touched)))
                if self.keep is not None:
                    merged = merged.filter(self.keep)
                to = {b: 1 - slots.get(b, 1) for b in touched}
                slot = F.when(F.col("bucket").isin([b for b, s in to.items() if s == 1]), 1).otherwise(0).cast("long")
                # a bucket grows with the table: a large one is written by several tasks, small ones by one together
                self._write(merged.withColumn("bucket", self._bucket()).withColumn("slot", slot).hint("rebalance", "bucket"), "data", "slot", "bucket")
                slots = slots | to
        finally:
            new.unpersist()
        rows = [(number, ALL, 0), *((number, b, s) for b, s in slots.items())]
        self._write(self.spark.createDataFrame(rows, POINTER).withColumn("turn", F.lit(number % 2)).coalesce(1), "pointer", "turn")
        return True

    def _write(self, rows: DataFrame, place: str, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{place}")


def feed(stream: DataFrame, store: KeyedStore, marks: str, then: Callable[[int], None] | None = None) -> None:
    """Merge every trigger of ``stream`` into ``store`` until the input is used up. ``then`` is called after each, also after a repeated one."""
    def take(batch: DataFrame, number: int) -> None:
        store.merge(batch, number)
        if then:
            then(number)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
