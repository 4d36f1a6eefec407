"""Plans of requests: how many of each kind, which rows they start from, and what is substituted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.ranks import ranked, ranked_within
from lexloom.sources.tables import kept

#: Values of a kind that a slot is held against at a time.
BANK = 16
#: The shares of the four kinds of request.
SHARES = {"paraphrase": 0.35, "slot_substitution": 0.30, "noise_codeswitch": 0.20, "hard_negative": 0.15}


def allocation(spark: SparkSession, total: int, shares: dict[str, float] | None = None) -> DataFrame:
    """(recipe, n): whole numbers that sum to total. Each share gets its whole part; what is left goes one by one to the largest
    fractions, and of equal ones to the later name."""
    if total < 1:
        raise ValueError("a plan needs a request")
    table = spark.createDataFrame(list((shares or SHARES).items()), "recipe string, share double")
    parts = table.withColumn("exact", F.col("share") * total).withColumn("whole", F.floor("exact"))
    left = total - F.sum("whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy((F.col("exact") - F.col("whole")).desc(), F.col("recipe").desc()))  # a few rows
    return parts.select("recipe", (F.col("whole") + (place <= left).cast("long")).alias("n"))


def cycled(pool: DataFrame, n: int, offset: int = 0, position: str = "pos") -> DataFrame:
    """Rows idx = 0 .. n - 1, each with the pool's row at (idx + offset) modulo its size, and the style that alternates."""
    spark = pool.sparkSession
    size = F.broadcast(pool.agg(F.count("*").alias("_size")))
    index = spark.range(n).withColumnRenamed("id", "idx").join(size).withColumn(position, F.pmod(F.col("idx") + offset, F.col("_size")).cast("long")).drop("_size")
    style = F.when(F.col("idx") % 2 == 0, "massive_like").otherwise("tw_colloquial")
    return index.join(pool.withColumn(position, F.col(position).cast("long")), position).withColumn("style", style)


def first_substitutions(slots: DataFrame) -> DataFrame:
    """For each row the first slot, by place, whose value is in the text and has another value of its kind that isn't.

    slots: row_id, row_pos, slot_pos, text, type, value. The replacement is the first by the place
    where the value first occurs in the table.

    A kind's values are ranked once and asked BANK at a time: a slot meets the first BANK of them, and only if all of
    these are its own value or in its text, the next. So a slot meets about as many values as its text has, not all.
    """
    place = F.struct("row_pos", "slot_pos")
    values = slots.groupBy("type", F.col("value").alias("replacement")).agg(F.min(place).alias("first_at"))
    placed = ranked_within(values, "type", "first_at", "replacement", name="at", start=0)
    banks = kept(placed.groupBy("type", F.floor(F.col("at") / BANK).alias("turn")).agg(F.array_sort(F.collect_list(F.struct("at", "replacement"))).alias("bank")))
    open_ = kept(slots.where(F.contains("text", F.col("value"))).select("row_id", "slot_pos", "text", "type", "value"))
    found, turn = [], 0
    while open_.limit(1).count():
        asked = open_.join(banks.where(F.col("turn") == turn).select("type", "bank"), "type")  # a kind without more values drops out
        fits = F.filter("bank", lambda b: (b["replacement"] != F.col("value")) & ~F.contains("text", b["replacement"]))
        met = kept(asked.withColumn("replacement", F.try_element_at(fits, F.lit(1))["replacement"]).drop("bank"))
        found.append(met.where("replacement IS NOT NULL").select("row_id", "slot_pos", "type", "value", "replacement"))
        open_, turn = met.where("replacement IS NULL").drop("replacement"), turn + 1
    if not found:
        return slots.select("row_id", "slot_pos", "type", "value", F.col("value").alias("replacement")).limit(0)
    best = reduce(DataFrame.unionByName, found).groupBy("row_id").agg(F.min(F.struct("slot_pos", "type", "value", "replacement")).alias("m"))
    return best.select("row_id", "m.slot_pos", "m.type", "m.value", "m.replacement")


def scheduled(plans: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    """plans with their turn from 0; the order is that of a hash, as a shuffle's can't be had on many machines."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)
    return ranked(plans.withColumn("_order", order), "_order", *key, name="turn", start=0).drop("_order")


def missing_indices(spark: SparkSession, n: int, done: DataFrame, index: str) -> DataFrame:
    """Of 0 .. n - 1, those that done doesn't have: what a resumed run still has to do."""
    return spark.range(n).withColumnRenamed("id", index).join(done.select(F.col(index).cast("long").alias(index)), index, "left_anti")


def sizing(lower: Column, minimum: Column, seconds_each: Column, wall_seconds: Column) -> tuple[Column, Column, Column]:
    """(rows required, rows that fit, whether they do)."""
    required, fits = F.ceil(F.try_divide(minimum, lower)), F.floor(F.try_divide(wall_seconds, seconds_each))
    return required, fits, F.coalesce(required <= fits, F.lit(False))
