"""The validation funnel over records: the first failing check gives a row its reason; cheap checks come first.

A record has sample (utt, intent, slots, recipe), expected (intent, slots) and raw text columns; see
lexloom/sources/schemas.py. All checks are built-in expressions and run inside the JVM, so Spark prunes
columns and short-circuits them; the funnel works the same on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import BANNED_TERMS, UNEXPECTED_SCRIPT, compatible, comparison_form, covered, han_share, holds, latin_share, simplified_count

#: The share of Latin letters that a recipe may have.
LATIN_LIMITS = {"noise_codeswitch": 0.55}
LATIN_LIMIT = 0.30
STAGES = ("F1", "F2", "F3", "F4")


def grounded(text: Column, values: Column) -> Column:
    """Whether all values get a place of their own in a text: longest first, each at its leftmost free place, all in exact comparison form."""
    placed = F.transform(values, lambda v, i: F.struct(i.alias("i"), comparison_form(F.coalesce(v, F.lit("")), exact=True).alias("form")))
    ordered = F.array_sort(F.transform(placed, lambda p: F.struct((-F.length(p["form"])).alias("length"), p["i"].alias("i"), p["form"].alias("form"))))
    return covered(comparison_form(text, exact=True), F.transform(ordered, lambda o: o["form"])).isNotNull()


def schema_reason(sample: Column) -> Column:
    slots = F.coalesce(sample["slots"], F.array().cast("array<struct<type:string,value:string>>"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    invalid = blank(sample["utt"]) | blank(sample["intent"]) | sample["slots"].isNull() | F.exists(slots, lambda s: blank(s["type"]) | blank(s["value"]))
    return F.when(sample.isNull(), "F1_SCHEMA_MISSING_SAMPLE").when(invalid, "F1_SCHEMA_INVALID")


def label_reason(sample: Column, expected: Column, intents: list[str], kinds: list[str]) -> Column:
    """Unknown labels first, then the contract with what was asked for; a null expectation is no contract."""
    pairs = lambda slots: F.array_sort(F.transform(slots, lambda s: F.struct(F.trim(s["type"]), F.trim(s["value"]))))
    return (
        F.when(~F.coalesce(F.trim(sample["intent"]).isin(intents), F.lit(False)), "F2_LABEL_UNKNOWN_INTENT")
        .when(F.exists(sample["slots"], lambda s: ~F.trim(s["type"]).isin(kinds)), "F2_LABEL_UNKNOWN_SLOT")
        .when(expected.isNotNull() & ~F.trim(sample["intent"]).eqNullSafe(expected["intent"]), "F2_LABEL_CONTRACT_INTENT")
        .when(expected.isNotNull() & expected["slots"].isNull(), "F1_SCHEMA_INVALID_EXPECTED")
        .when(expected.isNotNull() & (pairs(sample["slots"]) != pairs(expected["slots"])), "F2_LABEL_CONTRACT_SLOTS")
    )


def generation_reason(sample: Column, expected: Column) -> Column:
    """The contract of a request when its answer comes in: its intent, its slots in any order, and each value in the text; null if kept."""
    pairs = lambda slots: F.array_sort(F.transform(slots, lambda s: F.struct(s["type"], s["value"])))
    return (
        F.when(~sample["intent"].eqNullSafe(expected["intent"]), "F2_INTENT_CONTRACT")
        .when(~pairs(sample["slots"]).eqNullSafe(pairs(expected["slots"])), "F2_SLOT_CONTRACT")
        .when(F.exists(sample["slots"], lambda s: ~F.coalesce(holds(sample["utt"], s["value"]), F.lit(False))), "F3_UNGROUNDED_SLOT")
    )


def locale_reason(text: Column, recipe: Column) -> Column:
    limit = F.lit(LATIN_LIMIT)
    for name, value in LATIN_LIMITS.items():
        limit = F.when(recipe == name, value).otherwise(limit)
    latin, han = latin_share(text), han_share(text)
    return (
        F.when(simplified_count(text) > 0, "F4_LOCALE_SIMPLIFIED")
        .when(text.rlike(UNEXPECTED_SCRIPT), "F4_LOCALE_UNEXPECTED_SCRIPT")
        .when(F.exists(F.array(*map(F.lit, BANNED_TERMS)), lambda t: F.contains(text, t)), "F4_LOCALE_MAINLAND_TERM")
        .when((latin > limit) | ((han == 0) & (latin > 0)), "F4_LOCALE_LANGUAGE_RATIO")
    )


def validated(records: DataFrame, intents: list[str], kinds: list[str]) -> DataFrame:
    """records with passed_stage (null if none), reject_reason (null if none) and scores.

    Known labels pass F2 before the contract is looked at, so a row that breaks only the contract has passed F2.
    Where records have raw_reason (what reading them found wrong, see operators/records.py), that comes first.
    """
    sample, expected = F.col("sample"), F.col("expected")
    raw = F.col("raw_reason") if "raw_reason" in records.columns else F.lit(None).cast("string")
    cheap = records.withColumn("_f1", F.coalesce(raw, schema_reason(sample))).withColumn("_f2", F.when(F.col("_f1").isNull(), label_reason(sample, expected, intents, kinds)))
    asked = F.col("_f1").isNull() & F.col("_f2").isNull()
    values = F.transform(sample["slots"], lambda s: s["value"])
    read = cheap.withColumn("_placed", F.when(asked, grounded(sample["utt"], values))).withColumn("_text", F.when(F.col("_placed"), compatible(sample["utt"])))
    staged = read.withColumn("_f3", F.when(~F.col("_placed"), "F3_UNGROUNDED_OR_OVERLAPPING_SLOT")).withColumn("_f4", F.when(F.col("_placed"), locale_reason(F.col("_text"), sample["recipe"])))
    reason = F.coalesce("_f1", "_f2", "_f3", "_f4")
    passed = (
        F.when(reason.isNull(), "F4")
        .when(F.col("_f4").isNotNull(), "F3")
        .when(F.col("_f3").isNotNull() | F.col("_f2").startswith("F2_LABEL_CONTRACT") | (reason == "F1_SCHEMA_INVALID_EXPECTED"), "F2")
        .when(F.col("_f2").isNotNull(), "F1")
    )
    ratios = F.col("_placed") & (F.col("_f4").isNull() | (F.col("_f4") == "F4_LOCALE_LANGUAGE_RATIO"))
    given = {
        "slot_span_count": F.when(F.col("_placed"), F.size(values).cast("double")),
        "simplified_char_count": F.when(F.col("_f4") == "F4_LOCALE_SIMPLIFIED", simplified_count(F.col("_text")).cast("double")),
        "latin_ratio": F.when(ratios, latin_share(F.col("_text"))),
        "han_ratio": F.when(ratios, han_share(F.col("_text"))),
    }
    scores = F.map_filter(F.create_map(*[c for name, score in given.items() for c in (F.lit(name), score)]), lambda _, v: v.isNotNull())
    return staged.withColumns({"passed_stage": passed, "reject_reason": reason, "scores": scores}).drop("_f1", "_f2", "_f3", "_f4", "_placed", "_text")


def counts(decided: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected, and how many passed each stage."""
    position = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("passed_stage")), F.lit(0))
    passed = [F.count_if(position >= k + 1).alias(f"passed_{s.lower()}") for k, s in enumerate(STAGES)]
    return decided.agg(F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), *passed)


def reasons(decided: DataFrame) -> DataFrame:
    return decided.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))
