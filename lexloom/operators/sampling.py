"""Samples that depend on hashes only, so they are the same for every order and partitioning of the rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.hashing import rank_hash
from lexloom.operators.ranks import ranked


def per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum, with their rank. Spark keeps only n rows a stratum and task before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(rank_hash(seed, F.col(key)), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def exactly(df: DataFrame, key: str, n: int, seed: int = 42, namespace: str = "sample") -> DataFrame:
    """n rows by hash order; fewer in df is an error when it runs."""
    chosen = df.orderBy(rank_hash(seed, F.col(key), namespace), key).limit(n)
    counted = df.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") >= n, F.lit(f"fewer than {n} rows")).alias("_ok"))
    return chosen.join(F.broadcast(counted), how="left").where("_ok IS NULL").drop("_ok")


def audit(df: DataFrame, key: str, hard: Column, changed: Column, margin: Column, fraction: float, seed: int = 42) -> DataFrame:
    """Three disjoint strata: all hard rows; of the others, half of what is left by changed, margin and hash; the rest by hash.

    Places are taken by ranges over many tasks, as an audit's share of a large table is large itself.
    """
    rows = df.withColumns({"_hard": hard, "_changed": changed, "boundary_margin": margin})
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("_hard").alias("hard")).first()
    left = max(math.ceil(sizes.n * fraction), sizes.hard) - sizes.hard
    conflicts = -(-left // 2)
    by_conflict = rows.where("NOT _hard").withColumn("_order", rank_hash(seed, F.col(key), "conflict"))
    by_conflict = ranked(by_conflict, (~F.col("_changed")).asc(), F.asc_nulls_first("boundary_margin"), "_order", key, name="_rank")
    by_hash = by_conflict.where(F.col("_rank") > conflicts).withColumn("_order", rank_hash(seed, F.col(key), "random")).orderBy("_order", key).limit(left - conflicts)
    columns = [*df.columns, "boundary_margin", F.col("_changed").alias("slot_count_changed")]
    strata = {"hard_negative": rows.where("_hard"), "boundary_conflict": by_conflict.where(F.col("_rank") <= conflicts), "random": by_hash}
    return reduce(DataFrame.unionByName, [part.select(*columns, F.lit(name).alias("stratum")) for name, part in strata.items()])


def equal_size(groups: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """Of each group as many rows as the smallest has."""
    sizes = groups.groupBy(group).count().agg(F.min("count").alias("_least"))
    order = Window.partitionBy(group).orderBy(rank_hash(seed, F.col(key), "equal"), key)
    return groups.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(sizes)).where("_rank <= _least").drop("_rank", "_least")
