"""Contracts on tables, as rows that say what is wrong; none means the contract holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """(rule, n) for each rule that rows break; a rule is true for good rows."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n").where("n > 0")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def contiguous(df: DataFrame, index: str) -> DataFrame:
    """One row: n, and whether index runs from 0 to n - 1 without gaps or repeats."""
    seen = df.agg(F.count("*").alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.countDistinct(index).alias("distinct"))
    return seen.select("n", F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n")), F.col("n") == 0).alias("contiguous"))


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present, key, "left_anti")


def must_be_empty(df: DataFrame, message: str) -> DataFrame:
    """An action-time error with the message if df has a row, else no rows."""
    return df.limit(1).select(F.raise_error(F.lit(message)).alias("error"))


def close(a: Column, b: Column, relative: float | Column = 1e-12, absolute: float | Column | None = None) -> Column:
    """Whether two numbers differ by no more than a share of the larger one or an absolute amount, whichever is more; the amount is `relative` where none is given."""
    least = relative if absolute is None else absolute
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))
