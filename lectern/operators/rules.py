"""User patterns as a table: which pattern applies where, in which order, is data and not part of the plan.

A rule is a row ``scope, ordinal, pattern``; a text meets the rules of its scope (its language or book, say) by a join. Patterns are regular
expressions of the JVM with Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import clean as cl

MOST = 1000  # rules of one scope; they travel in one cell


def broken_rules(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rules whose pattern is no regular expression (or null), with an ``error``."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(pattern))
    return rules.filter(compiled.isNull()).withColumn("error", F.concat(F.lit("not a regular expression: "), F.coalesce(pattern, F.lit("nothing"))))


def check_rules(rules: DataFrame) -> None:
    """Raises if a pattern is broken, and names the first few. Only those reach the driver."""
    found = broken_rules(rules).orderBy("error").limit(5).collect()
    if found:
        raise ValueError("; ".join(r["error"] for r in found))


def by_scope(rules: DataFrame, scope: str = "scope") -> DataFrame:
    """``scope, rules``: a cell of ``ordinal, pattern`` in order for each scope. More than ``MOST`` in one scope are an error."""
    counted = rules.groupBy(scope).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit("(?U)"), "pattern").alias("run"), "pattern"))).alias("rules"))
    return counted.select(scope, F.when(F.col("_n") <= MOST, F.col("rules")).otherwise(F.raise_error(F.lit(f"more than {MOST} rules in one scope")).cast(counted.schema["rules"].dataType)).alias("rules"))


def _with_rules(df: DataFrame, rules: DataFrame, scope: str) -> DataFrame:
    """Rows with the rules of their scope as ``_rules``. One row per scope on the right; Spark sends it to the tasks where it is small."""
    right = by_scope(rules).withColumnsRenamed({"scope": "_scope", "rules": "_rules"})
    return df.join(right, F.col(scope) == F.col("_scope"), "left").drop("_scope")


def _first(value: Column) -> Column:
    return F.get(F.filter("_rules", lambda r: F.rlike(value, r["run"])), 0)["pattern"]


def drop_matching_lines(df: DataFrame, rules: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """Drop lines in which a rule of the row's ``scope`` finds something; the audit names the first by ordinal. Rows without scope, or in one without
    rules, keep all lines."""
    judged = F.transform(tx.lines(text), lambda line: F.struct(_first(line).alias("pattern"), line.alias("text")))
    return cl.drop_judged_lines(_with_rules(cl.with_audit(df), rules, scope).withColumn("_judged", judged).drop("_rules"), text)


def exclude_chapters(chapters: DataFrame, rules: DataFrame, scope: str, title: str = "title") -> DataFrame:
    """Chapters with ``excluded_by``, the first rule by ordinal that finds something in the title, or null."""
    return _with_rules(chapters, rules, scope).withColumn("excluded_by", _first(F.col(title))).drop("_rules")
