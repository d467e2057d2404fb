"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, *keep: Column | str, at: str = "_at", value: str = "_v") -> DataFrame:
    """One row per array element with its 0-based position ``at``; rows without elements vanish.

    A plain ``explode`` lets the optimizer infer a ``size(array) > 0`` filter and push it below every projection, which
    computes the array a second time (and its inputs once per reference). The outer form does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter evaluated after the columns it reads. ``filter`` would be pushed below costly projections and repeat them."""
    return unnest(df, F.when(condition, F.array(F.lit(True))), *df.columns).select(*df.columns)
