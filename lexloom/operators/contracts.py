"""What groups of training rows must keep to: sizes, ids, labels and digests, the same for every seed and as frozen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ranks import tree_digest

OBSERVED = ("rows", "unique_ids", "labels", "least", "most", "digest")


def observed(rows: DataFrame, group: str, key: str, label: str, value: Column) -> DataFrame:
    """(group, rows, unique_ids, labels, least, most, digest): least and most are the sizes of its labels; the digest is that of the rows' values in order of their keys."""
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("_n")).groupBy(group).agg(F.sum("_n").alias("rows"), F.count("*").alias("labels"), F.min("_n").alias("least"), F.max("_n").alias("most"))
    ids = rows.groupBy(group).agg(F.countDistinct(key).alias("unique_ids"))
    digests = tree_digest(rows.withColumn("_value", F.sha2(value, 256)), F.col("_value"), key, "_value", group=group).drop("n")
    return sizes.join(ids, group).join(digests, group).select(group, *OBSERVED)


def drift(now: DataFrame, frozen: DataFrame, group: str, *parts: str) -> DataFrame:
    """(group, part, was, is) for each part of observed() that isn't as frozen; a group that one side lacks has null there."""
    a, b = (df.select(group, *[F.col(p).cast("string").alias(p) for p in parts]).unpivot(group, list(parts), "part", name) for df, name in ((now, "is"), (frozen, "was")))
    return a.join(b, [group, "part"], "full_outer").where(~F.col("is").eqNullSafe(F.col("was"))).select(group, "part", "was", "is")


def additions(sizes: DataFrame, group: str, base: str, added: list[str]) -> DataFrame:
    """(group, added, fair): how many rows more than the base a group has, and whether all these groups have as many more."""
    least = sizes.where(F.col(group) == base).select(F.col("rows").alias("_base"))
    more = sizes.where(F.col(group).isin(added)).join(F.broadcast(least)).select(group, (F.col("rows") - F.col("_base")).alias("added"))
    same = more.agg((F.min("added") == F.max("added")).alias("fair"), F.count("*").alias("_n"))
    return more.join(F.broadcast(same)).select(group, "added", (F.col("fair") & (F.col("_n") == len(added))).alias("fair"))


def label_drift(labels: DataFrame, label: str, frozen: list[str]) -> DataFrame:
    """(label, problem): labels that are new or gone against a frozen catalogue."""
    then = labels.sparkSession.createDataFrame([(x,) for x in frozen], f"{label} string").withColumn("_was", F.lit(True))
    now = labels.select(label).distinct().withColumn("_is", F.lit(True))
    problem = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "gone")
    return now.join(then, label, "full_outer").select(label, problem.alias("problem")).where("problem IS NOT NULL")


def complete(reports: DataFrame, mode: str, target: int | None = None) -> Column:
    """Whether a report's row is whole: made in this mode, all of its target done, and the target the one asked for."""
    whole = (F.col("mode") == mode) & (F.col("completed") == F.col("target"))
    return F.coalesce(whole if target is None else whole & (F.col("target") == target), F.lit(False))


def unstable(by_seed: DataFrame, label: str, n: int) -> DataFrame:
    """(order, place, label, value): the n labels whose baseline moves most between seeds, and those with the largest single difference; ties by name.

    by_seed: label, base and new accuracy in per cent, a row a seed.
    """
    spread = by_seed.groupBy(label).agg((F.max("base") - F.min("base")).alias("range"), F.max(F.abs(F.col("new") - F.col("base"))).alias("swing"))
    out = []
    for order in ("range", "swing"):
        top = spread.orderBy(F.col(order).desc(), label).limit(n)
        ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("k"), F.col(label).alias("l")))).alias("t")).select(F.posexplode("t").alias("place", "t"))
        out.append(ranked.select(F.lit(order).alias("order"), (F.col("place") + 1).alias("place"), F.col("t.l").alias(label), (-F.col("t.k")).alias("value")))
    return out[0].unionByName(out[1])


def overridden(config: Column, key: str, value: str) -> Column:
    """A JSON object with one key set to a text, its other keys as they are, keys sorted; null if it isn't an object."""
    entries = F.map_filter(F.try_variant_get(F.try_parse_json(config), "$", "map<string,variant>"), lambda k, _: k != key)
    texts = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    own = F.array(F.struct(F.lit(key).alias("k"), quoted(F.lit(value)).alias("v")))
    parts = F.transform(F.array_sort(F.concat(texts, own)), lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["v"]))
    return F.when(entries.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> list[str]:
    """The lines of a table in a text, from a result, which is small: bars in cells are escaped, null is a dash."""
    cell = lambda v: "–" if v is None else (f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|")
    found = rows.select(*columns, *order).orderBy(*order).collect()
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in found)]
