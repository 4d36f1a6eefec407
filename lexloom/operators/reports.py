"""Joins and aggregates that reports are made of: run plans, what is missing, agreement, movement, ledgers, releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What mustn't be in a published text (keys of services, home folders), and placeholders left in cards.
SECRETS = r"(?im)[a-z]:[\\/](?:users|documents and settings)[\\/]|hf_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-[a-z0-9_-]{20,}"
PLACEHOLDERS = ("[More Information Needed]", "<!-- FILL")
#: Fixed value: percentage points of exact match that count as a detectable change.
DETECTABLE = 2.5


def run_plan(groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each group with each seed; both are small catalogues."""
    return groups.join(F.broadcast(seeds))


def planned(plan: DataFrame, reports: DataFrame, *key: str) -> DataFrame:
    """The plan with `available`: whether a report is there."""
    found = reports.select(*key).distinct().withColumn("available", F.lit(True))
    return plan.join(found, [*key], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def key_union(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of two maps with both values, null where a map hasn't the key."""
    return a.select(key, F.col(value).alias("left")).join(b.select(key, F.col(value).alias("right")), key, "full_outer")


def positional(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Rows of equal place together; a place that only one side has is an error when it runs."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), index, "full_outer")
    whole = F.col("_a") & F.col("_b")
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col(index)).otherwise(F.raise_error(F.lit("the sides have different lengths")))
    return both.withColumn(index, checked).drop("_a", "_b")


def paired(base: DataFrame, new: DataFrame, keys: list[str], same: str) -> DataFrame:
    """Rows of two models side by side: keys, the column that must be the same, and the others as base_ and new_. A row that only one side has, or a difference in `same`, is an error when it runs."""
    sides = []
    for name, rows in (("base", base), ("new", new)):
        sides.append(rows.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in keys], F.lit(True).alias(f"_{name}")))
    both = sides[0].join(sides[1], keys, "full_outer")
    where = F.concat_ws(",", *keys)
    alone = F.col("_base").isNull() | F.col("_new").isNull()
    checked = (
        F.when(alone, F.raise_error(F.concat(F.lit("only one side has the row "), where)).cast(base.schema[same].dataType))
        .when(~F.col(f"base_{same}").eqNullSafe(F.col(f"new_{same}")), F.raise_error(F.concat(F.lit(f"{same} differs at "), where)).cast(base.schema[same].dataType))
        .otherwise(F.col(f"base_{same}"))
    )
    return both.withColumn(same, checked).drop("_base", "_new", f"base_{same}", f"new_{same}")


def looked_up(names: DataFrame, rows: DataFrame, key: str, always: str) -> DataFrame:
    """names with what rows (unique by key) say of their key; a key that rows lack is an error when it runs. always: a column of rows that is never null there."""
    met = names.join(rows.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col(always)).otherwise(F.raise_error(F.concat(F.lit(f"no row has {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[always].dataType))
    return met.withColumn(always, checked).drop("_there")


def agreeing(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Inner join on key; a value that differs between the sides is an error when it runs."""
    joined = a.join(b.withColumnRenamed(value, "_value"), key)
    checked = F.when(F.col(value).eqNullSafe(F.col("_value")), F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"{value} differs at "), F.concat_ws(",", *key))))
    return joined.withColumn(value, checked).drop("_value")


def drifted(records: DataFrame, plan: DataFrame, index: str, fingerprint: str) -> DataFrame:
    """Records whose index the plan doesn't have, or has with another fingerprint: index, problem."""
    joined = records.select(index, F.col(fingerprint).alias("_is")).join(plan.select(index, F.col(fingerprint).alias("_was")), index, "left")
    problem = F.when(F.col("_was").isNull(), "outside the plan").when(F.col("_is") != F.col("_was"), "drift")
    return joined.select(index, problem.alias("problem")).where("problem IS NOT NULL")


def agreement(first: DataFrame, second: DataFrame, key: str, decision: str) -> DataFrame:
    """Pairs of decisions that both passes made, and the share of equal ones."""
    both = first.select(key, F.col(decision).alias("a")).join(second.select(key, F.col(decision).alias("b")), key).where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg(F.count("*").alias("pairs"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def with_total(rows: DataFrame, group: str, accepted: Column) -> DataFrame:
    """Samples, accepted, rejected and rate per group, and a row 'all'."""
    counted = rows.withColumn("_ok", F.coalesce(accepted, F.lit(False))).rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("samples"), F.count_if("_ok").alias("accepted"))
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col(group))
    return counted.select(name.alias(group), "samples", "accepted", (F.col("samples") - F.col("accepted")).alias("rejected"), F.try_divide("accepted", "samples").alias("rate"))


def count_spread(rows: DataFrame, group: str) -> DataFrame:
    """Of the sizes of the groups: least, median, greatest."""
    return rows.groupBy(group).count().agg(F.count("*").alias("groups"), F.min("count").alias("least"), F.median("count").alias("median"), F.max("count").alias("greatest"))


def round_robin(rows: DataFrame, group: str, first: str, order: Column, at_most: int, n: int) -> DataFrame:
    """n rows: up to at_most of the group `first`, then one of each group in turn. Only n rows of a group can be taken, so ranks stop there."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_rank") <= n)
    head = (F.col(group) == first) & (F.col("_rank") <= at_most)
    turn = F.when(F.col(group) == first, F.col("_rank") - at_most).otherwise(F.col("_rank"))
    return ranked.orderBy(F.when(head, 0).otherwise(1), F.when(head, 0).otherwise(turn), group, "_rank").limit(n).drop("_rank")


def throughput(rows: Column, seconds: Column, hours: float) -> tuple[Column, Column, Column]:
    """(rows a second, seconds a row, rows that fit in so many hours)."""
    each = F.try_divide(seconds, rows)
    return F.try_divide(rows, seconds), each, F.floor(F.try_divide(F.lit(hours * 3600), each))


def detectable(metrics: DataFrame, control: str, group: str = "grp", value: str = "exact_match") -> DataFrame:
    """Each group's change to the control in percentage points, and whether it is detectable; the control's never is."""
    base = metrics.where(F.col(group) == control).select(F.col(value).alias("_base"))
    change = (F.col(value) - F.col("_base")) * 100
    return metrics.join(F.broadcast(base)).select(group, change.alias("delta"), ((F.col(group) != control) & (F.abs(change) >= DETECTABLE)).alias("detectable"))


def unsafe(text: Column) -> Column:
    """Why a text mustn't be published; null if it may."""
    holds = lambda p: F.contains(text, F.lit(p))
    return F.when(text.rlike(SECRETS), "secret or local path").when(reduce(lambda a, b: a | b, map(holds, PLACEHOLDERS)), "placeholder")


def finalized(rows: DataFrame, verdicts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows without those judged bad, verdicts that name no row). Rows without a verdict stay; the second must be empty for a release."""
    bad = verdicts.where(~F.col("accepted")).select(key).distinct()
    return rows.join(bad, key, "left_anti"), verdicts.join(rows.select(key), key, "left_anti").select(key)


def released(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """finalized() rows; a verdict that names no row is an error when it runs, so nothing goes out on it."""
    kept, unknown = finalized(rows, verdicts, key)
    told = F.concat(F.lit("verdicts on unknown rows, the first on "), F.coalesce(F.col("_first").cast("string"), F.lit("null")))
    check = unknown.agg(F.count("*").alias("_n"), F.min(key).alias("_first")).select(F.when(F.col("_n") > 0, F.raise_error(told)).alias("_ok"))
    return kept.join(F.broadcast(check), how="left").where("_ok IS NULL").drop("_ok")


def margin(prior: Column, seed: Column, evaluation: Column, duplicate: float, too_close: float, outlier: float, contamination: float) -> Column:
    """The least distance to a limit of the semantic decisions."""
    return F.least(F.lit(duplicate) - prior, F.lit(too_close) - seed, seed - F.lit(outlier), F.lit(contamination) - evaluation)


def extremes(nearest: DataFrame, texts: DataFrame, n: int, largest: bool = True) -> DataFrame:
    """The n most (or least) similar of nearest (id, similarity, nearest_id), with both texts and whether they are equal; texts: id, text."""
    order = F.col("similarity").desc() if largest else F.col("similarity").asc()
    top = nearest.orderBy(order, "id").limit(n)
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"{x}_text")) for x in ("id", "nearest_id"))
    return top.join(a, "id").join(b, "nearest_id").withColumn("text_equal", F.col("id_text") == F.col("nearest_id_text"))


def segments(text: Column, values: Column) -> Column:
    """What stands between values, in the order in which they come: for n values n + 1 parts; null if one isn't there."""
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, value: Column) -> Column:
        at = F.position(value, state["rest"])
        return F.when(at > 0, F.struct(F.substring(state["rest"], at + F.length(value), F.length(state["rest"])).alias("rest"), F.array_append(state["parts"], F.substring(state["rest"], F.lit(1), at - 1)).alias("parts")))

    return F.aggregate(values, start, cut, lambda s: F.array_append(s["parts"], s["rest"]))


def rebuilt(parts: Column, values: Column) -> Column:
    """The text of segments() with values (others, perhaps) in their places."""
    return F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that only one of two tables has, however often. Null is a key."""
    sides = before.select(key, F.lit(True).alias("_before")).unionByName(after.select(key, F.lit(False).alias("_before")))
    seen = sides.groupBy(key).agg(F.bool_or("_before").alias("_was"), F.bool_and("_before").alias("_gone"))
    return seen.where("_gone OR NOT _was").select(key, F.when(F.col("_gone"), "gone").otherwise("new").alias("change"))
