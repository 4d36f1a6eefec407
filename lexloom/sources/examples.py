"""Examples from annotated splits and from vector archives, with the checks that go with reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import annotated
from lexloom.sources.tables import decoded

ROLES = ("pilot", "seed", "eval")


def from_annotated(rows: DataFrame, intents: list[str], prefix: str = "", limit: int | None = None) -> DataFrame:
    """(id, utt, intent, slots) of rows with id, intent (a code) and annot_utt; an annotation that can't be read, or an unknown code, is an error when it runs.

    prefix is put before ids, as of a split: "validation:". limit takes the first rows by id, where a dry run asks for few.
    """
    first = rows if limit is None else rows.orderBy("id").limit(limit)
    read = decoded(first, "intent", intents).withColumn("_a", annotated(F.col("annot_utt")))
    told = F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(": "))
    problem = F.when(F.col("_a.error").isNotNull(), F.concat(told, F.col("_a.error"))).when(F.col("intent").isNull(), F.concat(told, F.lit("unknown intent")))
    utt = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("_a.utterance"))
    return read.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), utt.alias("utt"), "intent", F.col("_a.slots").alias("slots"))


def expected() -> Column:
    """What a probe's answer is held against, from its row: struct(id, utt, intent, slots)."""
    return F.struct("id", "utt", "intent", "slots")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (id, role, ord, vec) as an archive with a folder a role."""
    vectors.select(F.col("id").cast("string").alias("id"), "role", F.col("ord").cast("long").alias("ord"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").partitionBy("role").parquet(path)


def read_vectors(spark: SparkSession, path: str, roles: tuple[str, ...] = ROLES, ids: dict[str, DataFrame] | None = None) -> DataFrame:
    """An archive's vectors, checked before any is given out: every role is there, all vectors have one length and ord runs from 0 without gaps or
    repeats in each role; and where ids (id, ord) of a role are given, the archive has exactly these, in this order."""
    rows = spark.read.schema("id STRING, ord BIGINT, vec ARRAY<FLOAT>, role STRING").parquet(path)
    seen = {r.role: r for r in rows.groupBy("role").agg(F.count("*").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.countDistinct("ord").alias("ords"), F.min(F.size("vec")).alias("short"), F.max(F.size("vec")).alias("long")).collect()}
    if missing := [r for r in roles if r not in seen]:
        raise ValueError(f"{path}: no vectors of {', '.join(missing)}")
    if len({s for r in seen.values() for s in (r.short, r.long)}) != 1:
        raise ValueError(f"{path}: vectors of different lengths")
    for role, r in seen.items():
        if (r.low, r.high, r.ords) != (0, r.n - 1, r.n):
            raise ValueError(f"{path}: places of {role} aren't 0 to {r.n - 1}")
    for role, given in (ids or {}).items():
        a, b = rows.where(F.col("role") == role).select("ord", F.col("id").alias("_is")), given.select(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("_was"))
        off = a.join(b, "ord", "full_outer").where(~F.col("_is").eqNullSafe(F.col("_was"))).orderBy("ord").limit(1).collect()
        if off:
            raise ValueError(f"{path}: {role} at {off[0].ord} is {off[0]['_is']}, not {off[0]['_was']}")
    return rows.where(F.col("role").isin(*roles))
