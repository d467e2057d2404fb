"""Helpers over DataFrames: a filter of fixed size, and connected components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from ..session import stable

FILTER_BITS = 24


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it (case does not count)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def whole_numbers(df: DataFrame, column: str) -> None:
    """Raises if ``column`` does not hold whole numbers."""
    kind = df.select(column).schema[0].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{column} is {kind.simpleString()}; ids have to be whole numbers")


def slot(value: Column) -> Column:
    """The bit a value sets in a filter."""
    return F.pmod(F.xxhash64(value), F.lit(1 << FILTER_BITS)).cast("int")


def bit_filter(slots: DataFrame) -> np.ndarray:
    """Bits of all values of the one column of ``slots``.

    Two megabytes, whatever the input: the filter is put together on the executors, and at most 2**18 words of it come back.
    A value that was never added may pass, so exact work has to follow; one that was added always passes.
    """
    name = slots.columns[0]
    packed = (slots.groupBy(F.shiftright(name, 6).alias("word"))
              .agg(F.bit_or(F.expr(f"shiftleft(1L, {name} & 63)")).alias("bits")).toArrow())
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    return words.view(np.uint64)


def passes(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def follow(parents: DataFrame) -> DataFrame:
    """Roots of a forest ``node, up`` (a root is its own ``up``): ``node, label``. Depth halves in each round."""
    labels = stable(parents.select("node", F.col("up").alias("label")))
    while True:
        above = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = stable(labels.join(above, labels["label"] == above["_n"]).select("node", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (``a, b``): ``node, label``.

    Each round takes the smallest label of the neighbours and then the label of that label. Labels live in written tables;
    only a flag reaches the driver.
    """
    both = stable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "_n"), F.col("b") == F.col("_n"))
                .groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("near")))
        lower = labels.join(near, F.col("node") == F.col("_a")).select("node", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = stable(lower.join(above, F.col("low") == F.col("_n")).select("node", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
