"""Running totals over ordered groups of any size.

A window function sorts a whole group in one task, which is wrong for a group that holds a third of the table. Here rows are
range-partitioned by key and order, so a large group covers several ranges and small ones share a range. Each range computes
local running totals; a key that continues from the range before carries that key's totals in. There is one such key per
range at most, so the carried totals are one row per range. The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

EXACT = "decimal(38,9)"
LARGEST = 1e15  # of a floating-point measure; sums of more rows than there can be stay exact


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Add inclusive running sums per key. ``order`` must be unique within a key.

    A running count is ``{"n": F.lit(1)}``. Floating-point measures are summed as decimals with nine places, so that totals do not
    depend on how rows are divided. A measure that is not a number, infinite or beyond ``LARGEST`` makes its total unknown: null at that row and all
    later ones of the key. A null measure adds nothing. ``parts``: number of ranges, ``spark.sql.shuffle.partitions`` by default.
    """
    names = list(sums)
    source = df.select("*", *[sums[n].alias(f"_m_{n}") for n in names])
    kinds = {n: source.schema[f"_m_{n}"].dataType.simpleString() for n in names}
    real = [n for n in names if kinds[n] in ("double", "float")]
    known = {n: F.abs(f"_m_{n}") < LARGEST for n in real}  # NaN is greater than any number
    source = source.withColumns({f"_m__broken_{n}": (~known[n]).cast("bigint") for n in real})
    source = source.withColumns({f"_m_{n}": F.when(known[n], F.col(f"_m_{n}")).cast(EXACT) for n in real})
    names = names + [f"_broken_{n}" for n in real]
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the written table pins each row to its range
    ranged = stable(source.repartitionByRange(count, *keys, *order).withColumn("_span", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_span").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (totals.select(*keys, "_span", F.count("*").over(before).alias("_before"), *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names])
               .filter("_before > 0").drop("_before"))
    window = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({n: F.sum(f"_m_{n}").over(window) for n in names})
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_span"]]
    joined = local.alias("a").join(F.broadcast(carried).alias("b"), same, "left")  # one row per range at most
    value = {n: F.coalesce(F.col(f"a.{n}") + F.col(f"b._o_{n}"), F.col(f"a.{n}"), F.col(f"b._o_{n}")) for n in names}
    value |= {n: F.when(F.coalesce(value[f"_broken_{n}"], F.lit(0)) == 0, value[n]).cast("double") for n in real}
    return joined.select(*[F.col(f"a.{c}") for c in df.columns if c not in sums], *[value[n].alias(n) for n in sums])


def position(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """A dense 1-based position per key."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, parts)


def longest_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, parts: int | None = None) -> DataFrame:
    """Length of every run of consecutive flagged rows: ``keys, run_id, run_length``."""
    marked = df.withColumn("_flag", flag.cast("bigint"))
    counted = running(marked, keys, order, {"_seen": F.lit(1).cast("bigint"), "_hits": F.col("_flag")}, parts)
    runs = counted.filter(F.col("_flag") == 1).withColumn("run_id", F.col("_seen") - F.col("_hits"))
    return runs.groupBy(*keys, "run_id").agg(F.count("*").alias("run_length"))
