"""Scores of predicted labels and slots against expected ones, at the level of rows, labels and groups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = "array<struct<type:string,value:string>>"
PARSED = f"struct<outcome:string,intent:string,slots:{SLOTS}>"
OUTCOMES = ("valid", "json_decode_error", "unknown_intent", "unknown_slot_type", "schema_validation_error")


def _strict(raw: str, intents: frozenset[str], kinds: frozenset[str]) -> tuple[str, str | None, list | None]:
    try:
        value = json.loads((raw or "").strip())
    except (ValueError, RecursionError):  # also what is nested too deep
        return "json_decode_error", None, None
    if not isinstance(value, dict) or set(value) != {"intent", "slots"} or not isinstance(value["intent"], str) or not isinstance(value["slots"], list):
        return "schema_validation_error", None, None
    slots = []
    for slot in value["slots"]:
        if not isinstance(slot, dict) or set(slot) != {"type", "value"} or not all(isinstance(x, str) and x.strip() for x in slot.values()):
            return "schema_validation_error", None, None
        slots.append({k: x.strip() for k, x in slot.items()})
    if value["intent"].strip() not in intents:
        return "unknown_intent", None, None
    if any(s["type"] not in kinds for s in slots):
        return "unknown_slot_type", None, None
    return "valid", value["intent"].strip(), slots


def strict_parse(intents: list[str], kinds: list[str]):
    """A column function: outcome, intent and slots of a response that must be nothing but the JSON asked for.

    Spark's own JSON functions take trailing text and refuse repeated keys, so this is Python, in Arrow batches.
    """
    known, types = frozenset(intents), frozenset(kinds)

    @F.pandas_udf(PARSED)
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([_strict(r, known, types) for r in part], columns=["outcome", "intent", "slots"])

    return parse


def _structure(raw: str | None) -> list[bool]:
    try:
        value = json.loads(raw or "")
    except (ValueError, RecursionError):
        return [False] * 5
    if not isinstance(value, dict):
        return [True, *[False] * 4]
    slots = value.get("slots")
    listed = isinstance(slots, list)
    return [True, True, isinstance(value.get("intent"), str), listed, listed and all(isinstance(s, dict) for s in slots)]


STRUCTURE = ("json_syntax_valid", "json_object", "intent_is_string", "slots_is_list", "slot_object_list")


def structure(rows: DataFrame, raw: str) -> DataFrame:
    """One row: n_rows, and how many responses reach each step of STRUCTURE."""

    @F.pandas_udf("array<boolean>")
    def steps(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([_structure(r) for r in part])

    read = rows.select(steps(raw).alias("s"))
    return read.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("s")[k]).alias(n) for k, n in enumerate(STRUCTURE)])


def outcome_counts(parsed: DataFrame, outcome: str = "outcome") -> DataFrame:
    """(outcome, n) for each possible outcome, zeros included."""
    spark = parsed.sparkSession
    names = spark.createDataFrame([(k, o) for k, o in enumerate(OUTCOMES)], "position int, outcome string")
    counts = parsed.groupBy(F.col(outcome).alias("outcome")).count()
    return names.join(counts, "outcome", "left").select("position", "outcome", F.coalesce("count", F.lit(0)).alias("n"))


def accuracy(rows: DataFrame, *groups: str, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Row count, share of valid (non-null) predictions and accuracy; invalid rows count as wrong."""
    hit = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False)).cast("double")
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.col(predicted).isNotNull().cast("double")).alias("valid_rate"), F.avg(hit).alias("accuracy"))


def label_f1(rows: DataFrame, catalogue: DataFrame, *groups: str, label: str = "label", expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """F1 of each label of the catalogue, also of those without rows. One shuffle: expected and predicted labels are counted as rows."""
    hit = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    sides = F.array(F.struct(F.col(expected).alias(label), F.lit(1).alias("e"), F.lit(0).alias("p"), hit.cast("int").alias("tp")), F.struct(F.col(predicted).alias(label), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    counts = rows.select(*groups, F.inline(sides)).groupBy(*groups, label).agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    grid = rows.select(*groups).distinct().join(F.broadcast(catalogue.select(label))) if groups else catalogue.select(label)
    found = grid.join(counts, [*groups, label], "left")
    return found.select(*groups, label, F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("e") + F.col("p")), F.lit(0.0)).alias("f1"))


def macro_f1(rows: DataFrame, catalogue: DataFrame, *groups: str, **names: str) -> DataFrame:
    return label_f1(rows, catalogue, *groups, **names).groupBy(*groups).agg(F.avg("f1").alias("macro_f1"))


def slot_counts(expected: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn of multisets: both tables have keys and columns that make a slot; equal rows are counted."""
    both = expected.withColumn("_e", F.lit(1)).unionByName(predicted.withColumn("_e", F.lit(0)))
    counts = both.groupBy(*expected.columns).agg(F.sum("_e").alias("e"), F.sum(1 - F.col("_e")).alias("p"))
    return counts.groupBy(*keys).agg(F.sum(F.least("e", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("p"), F.lit(0))).alias("fn"))


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(1.0))


def same_slots(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
