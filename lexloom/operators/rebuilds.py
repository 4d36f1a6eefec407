"""Named numbers of a report, computed again and compared with what was published.

A report is a long table (path, value): a number's path names group, seed and metric, joined by dots. Comparing is
one full outer join, so a number that was changed, left out or added is named by its path.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.checks import close

#: Fixed value: relative and absolute tolerance of numbers that are written in full.
TOLERANCE = 1e-12


def named(rows: DataFrame, prefix: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """(path, value) of a table of metrics: prefix, the keys' values and the metric's name."""
    wide = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("null")).alias(k) for k in keys], *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, "_metric", "value").select(F.concat_ws(".", F.lit(prefix), *keys, "_metric").alias("path"), "value")


def numbers(document: Any, path: str = "") -> list[tuple[str, float]]:
    """All numbers of a parsed JSON document with their paths; list elements have their place."""
    if isinstance(document, bool) or document is None or isinstance(document, str):
        return []
    if isinstance(document, (int, float)):
        return [(path, float(document))]
    items = document.items() if isinstance(document, dict) else enumerate(document)
    return [found for k, v in items for found in numbers(v, f"{path}.{k}" if path else str(k))]


def published(spark: SparkSession, document: Any) -> DataFrame:
    """(path, value) of a report's document, which is small."""
    return spark.createDataFrame(numbers(document), "path string, value double")


def compared(found: DataFrame, told: DataFrame, relative: float | Column = TOLERANCE, absolute: float | Column = TOLERANCE) -> DataFrame:
    """(path, found, told, problem): the numbers that aren't told, aren't found, or differ by more than the tolerances allow. Two nulls agree."""
    a, b = found.select("path", F.col("value").alias("found"), F.lit(True).alias("_a")), told.select("path", F.col("value").alias("told"), F.lit(True).alias("_b"))
    both = a.join(b, "path", "full_outer")
    x, y = F.col("found"), F.col("told")
    near = close(x, y, relative, absolute)
    same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)
    problem = F.when(F.col("_b").isNull(), "not told").when(F.col("_a").isNull(), "not found").when(~same, "differs")
    return both.select("path", "found", "told", problem.alias("problem")).where("problem IS NOT NULL")


def verified(found: DataFrame, told: DataFrame, relative: float = TOLERANCE, absolute: float = TOLERANCE, named_at_most: int = 10) -> None:
    """An error that names the first numbers that don't agree, and how many there are."""
    wrong = compared(found, told, relative, absolute)
    first = wrong.orderBy("path").limit(named_at_most).collect()
    if first:
        raise ValueError(f"{wrong.count()} numbers don't agree: " + "; ".join(f"{r.path} {r.problem} (found {r.found}, told {r.told})" for r in first))


def sample_manifest(sampled: DataFrame, label: str, key: str) -> DataFrame:
    """(label, n, digest) of a sample: what a frozen split is known by. The digest is that of the sorted keys."""
    keys = F.array_sort(F.collect_list(F.col(key).cast("string")))  # a sample's size a label is a parameter of it
    return sampled.groupBy(label).agg(F.count("*").alias("n"), F.sha2(F.array_join(keys, "\n"), 256).alias("digest"))


def manifest_changes(now: DataFrame, then: DataFrame, label: str) -> DataFrame:
    """(label, problem) of two sample_manifest(): labels that only one has, and labels whose keys differ."""
    a, b = now.select(label, F.struct("n", "digest").alias("_now")), then.select(label, F.struct("n", "digest").alias("_then"))
    problem = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now")["n"] != F.col("_then")["n"], "other size").when(F.col("_now")["digest"] != F.col("_then")["digest"], "other rows")
    return a.join(b, label, "full_outer").select(label, problem.alias("problem")).where("problem IS NOT NULL")
