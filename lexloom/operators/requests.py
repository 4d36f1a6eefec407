"""Plans of requests to a generator: four recipes over one pool of seeds, in one table with fingerprints.

The number of requests of each recipe is an allocation of the total; each recipe cycles over its seeds.
All is joins and expressions; nothing but the four numbers comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.hashing import pair_id
from lexloom.functions.text import compact_json, filled, substituted
from lexloom.operators import planning
from lexloom.operators.ranks import ranked, ranked_within

SLOTS = "array<struct<type: string, value: string>>"
#: Fixed value: where in the pool the noisy requests begin.
NOISE_OFFSET = 311
STYLES = {"massive_like": "Keep the plain register of a voice command.", "tw_colloquial": "Use the colloquial Mandarin of Taiwan."}
#: What a request asks for; {{...}} is filled from the seed.
TEMPLATES = {
    "paraphrase": "Say this differently and keep every label. {{STYLE}} Seed: {{SEED}}",
    "slot_substitution": "A value of this example was replaced; make it read well and change nothing else. {{STYLE}} Draft: {{SEED}}",
    "noise_codeswitch": "Write this as it would be said in a noisy chat, values as they are. {{STYLE}} Seed: {{SEED}}",
    "hard_negative": "Change the first example as little as possible until it means the second. {{STYLE}} First: {{ANCHOR}} Second: {{SEED}}",
}
VERSIONS = {"paraphrase": "paraphrase.v2", "slot_substitution": "slot_substitution.v1", "noise_codeswitch": "noise_codeswitch.v2", "hard_negative": "hard_negative.v2"}
COLUMNS = ("recipe", "idx", "style", "expected_intent", "expected_slots", "seed_ids", "pair_id", "prompt")


def prompt(template: str, values: dict[str, Column]) -> Column:
    """A filled template; a placeholder that is left is an error when it runs."""
    text = filled(template, values)
    return F.coalesce(text, F.raise_error(F.lit(f"a placeholder is left in: {template}")).cast("string"))


def seed_json(id_: str, utt: Column, intent: str, slots: Column) -> Column:
    return compact_json(F.struct(F.col(id_).alias("id"), utt.alias("utt"), F.col(intent).alias("intent"), slots.alias("slots")))


def _style_text(style: Column) -> Column:
    return F.when(style == "massive_like", STYLES["massive_like"]).otherwise(STYLES["tw_colloquial"])


def _request(recipe: str, rows: DataFrame, templates: dict[str, str], *, style: Column, slots: Column, seeds: Column, values: dict[str, Column], pair: Column | None = None) -> DataFrame:
    asked = prompt(templates[recipe], {"STYLE": _style_text(style), **values})
    none = F.lit(None).cast("string")
    return rows.select(F.lit(recipe).alias("recipe"), "idx", style.alias("style"), F.col("intent").alias("expected_intent"), slots.cast(SLOTS).alias("expected_slots"), seeds.alias("seed_ids"), (none if pair is None else pair).alias("pair_id"), asked.alias("prompt"))


def substitution_seeds(pool: DataFrame) -> DataFrame:
    """Rows of pool with a value that another can stand in for, with text and first such slot replaced; pos is their place among these."""
    exploded = pool.select(F.col("id").alias("row_id"), F.col("pos").alias("row_pos"), F.col("utt").alias("text"), F.posexplode("slots").alias("slot_pos", "s")).select("*", "s.type", "s.value").drop("s")
    found = planning.first_substitutions(exploded).withColumnRenamed("row_id", "id")
    met = pool.withColumnRenamed("pos", "_pos").join(found, "id")
    place = F.array_position("slots", F.struct(F.col("type").alias("type"), F.col("value").alias("value")))
    slots = F.transform("slots", lambda s, i: F.when(i + 1 == place, F.struct(s["type"].alias("type"), F.col("replacement").alias("value"))).otherwise(s))
    changed = met.select("id", substituted(F.col("utt"), F.col("value"), F.col("replacement")).alias("utt"), "intent", slots.alias("slots"), "_pos")
    return ranked(changed, "_pos", name="pos", start=0).drop("_pos")


def hard_pairs(pool: DataFrame, pairs: list[tuple[str, str]], n: int) -> DataFrame:
    """idx 0 .. n - 1 with the anchor's and the target's seed of the pair whose turn it is; an intent without seeds is an error when it runs."""
    spark = pool.sparkSession
    size = len(pairs)
    turns = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, anchor string, target string")
    index = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") % size).cast("int").alias("pair"), F.floor(F.col("id") / size).alias("cycle")).join(F.broadcast(turns), "pair")
    placed = ranked_within(pool, "intent", "pos", name="at", start=0, size="of")
    sizes = placed.select("intent", "of").distinct()
    out = index
    for side in ("anchor", "target"):
        of = sizes.select(F.col("intent").alias(side), F.col("of").alias("_of"))
        at = F.when(F.col("_of").isNull(), F.raise_error(F.concat(F.lit("no seeds of "), side)).cast("long")).otherwise(F.pmod(F.col("cycle"), F.col("_of")))
        seeds = placed.select(F.col("intent").alias(side), F.col("at").alias("_at"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "utt", "slots")])
        out = out.join(of, side, "left").withColumn("_at", at).drop("_of").join(seeds, [side, "_at"]).drop("_at")
    return out


def plan(spark: SparkSession, total: int, pool: DataFrame, pairs: list[tuple[str, str]], templates: dict[str, str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly total requests: turn, COLUMNS and fingerprint.

    pool: pos (0 .. n - 1), id, utt, intent, slots. pairs: intents that are easily confused, (anchor, target), of different intents.
    """
    templates = templates or TEMPLATES
    if any(a == b for a, b in pairs):
        raise ValueError("a hard negative needs two intents")
    counts = {r.recipe: r.n for r in planning.allocation(spark, total).collect()}
    if not pool.limit(1).count():
        raise ValueError("a plan needs seeds")
    parts, seed_of = [], F.array("id")
    whole = seed_json("id", F.col("utt"), "intent", F.col("slots"))
    given = {"style": F.col("style"), "slots": F.col("slots"), "seeds": seed_of, "values": {"SEED": whole}}
    parts.append(_request("paraphrase", planning.cycled(pool, counts["paraphrase"]), templates, **given))
    if counts["slot_substitution"]:
        drafts = substitution_seeds(pool)
        if not drafts.limit(1).count():
            raise ValueError("no value has a substitute")
        parts.append(_request("slot_substitution", planning.cycled(drafts, counts["slot_substitution"]), templates, **given))
    noisy = planning.cycled(pool, counts["noise_codeswitch"], NOISE_OFFSET)
    parts.append(_request("noise_codeswitch", noisy, templates, **given | {"style": F.lit("tw_colloquial")}))
    if counts["hard_negative"]:
        hard = hard_pairs(pool, pairs, counts["hard_negative"]).withColumn("intent", F.col("target"))
        style = F.when(F.col("idx") % 2 == 0, "massive_like").otherwise("tw_colloquial")
        values = {"SEED": seed_json("target_id", F.col("target_utt"), "target", F.col("target_slots")), "ANCHOR": seed_json("anchor_id", F.col("anchor_utt"), "anchor", F.col("anchor_slots"))}
        ids = F.array("anchor_id", "target_id")
        parts.append(_request("hard_negative", hard, templates, style=style, slots=F.col("target_slots"), seeds=ids, values=values, pair=pair_id(F.col("anchor_id"), F.col("target_id"))))
    rows = reduce(DataFrame.unionByName, parts)
    return planning.scheduled(rows.withColumn("fingerprint", fingerprint()), "recipe", "idx", seed=seed)


def fingerprint() -> Column:
    """What a request is known by: everything that is sent or expected."""
    version = reduce(lambda rest, r: F.when(F.col("recipe") == r, VERSIONS[r]).otherwise(rest), VERSIONS, F.lit(None).cast("string"))
    return F.sha2(compact_json(F.struct(version.alias("version"), *COLUMNS[2:])), 256)
