"""Queries on vectors, predictions, statistics and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.intervals import Z_SIZING, gap_closed, holm, mcnemar_p, t_interval, wilson
from lexloom.operators import augmentation, bootstrap, planning, scoring, similarity
from lexloom.operators.ranks import ranked, ranked_within
from lexloom.sources.tables import kept, table

#: Stand-in limits for the embeddings at hand, off any ties.
LIMITS = similarity.Thresholds(duplicate=0.35, too_close=0.45, outlier=0.25, contamination=0.45)


def _vectors(spark: SparkSession, d: str, residues: list[int] | None = None, dims: int | None = None) -> DataFrame:
    rows = table(spark, d, "embeddings")
    vec = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    out = rows.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), similarity.unit(vec).alias("vec"), "label")
    return out if residues is None else out.where((F.col("id") % 10).isin(residues))


def nearest_seed(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.nearest(_vectors(spark, d, list(range(2, 10))), _vectors(spark, d, [0]))
    return found.select("id", F.round("similarity", 6).alias("similarity"), "nearest_id")


def nearest_nonself_quantiles(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = similarity.nearest_other(v)
    q = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    row = found.agg(F.percentile("similarity", F.array(*map(F.lit, q))).alias("q"))
    return row.select(F.posexplode("q").alias("at", "value")).select(F.element_at(F.array(*map(F.lit, q)), F.col("at") + 1).alias("quantile"), F.round("value", 6).alias("value"))


def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.nearest(_vectors(spark, d, list(range(2, 10))), _vectors(spark, d, [0]))
    return found.groupBy(F.width_bucket(F.round("similarity", 6), F.lit(0.0), F.lit(1.0), F.lit(35)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def semantic_decisions(spark: SparkSession, d: str) -> DataFrame:
    out = similarity.decisions(_vectors(spark, d, list(range(2, 10))), _vectors(spark, d, [0]), _vectors(spark, d, [1]), LIMITS, kept)
    return out.select("id", "reject_reason", *[F.round(c, 6).alias(c) for c in ("max_prior", "max_seed", "max_eval")], "nearest_eval_id")


def exclusion_log(spark: SparkSession, d: str) -> DataFrame:
    out = similarity.decisions(_vectors(spark, d, list(range(2, 10))), _vectors(spark, d, [0]), _vectors(spark, d, [1]), LIMITS, kept)
    split = F.when(F.col("nearest_eval_id") % 4 == 1, "validation").otherwise("test")
    return similarity.exclusions(out, split).withColumn("similarity", F.round("similarity", 6))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two models, base and full: a vector's label is that of its nearest seed, by half of the dimensions or by all. seed = id % 3; some predictions are missing."""
    v = _vectors(spark, d)
    asked, seeds = v.where("id % 10 > 0"), v.where("id % 10 = 0")
    found = similarity.nearest_by_width(asked, seeds, (32, 64))
    labels = seeds.select(F.col("id").alias("nearest_id"), F.col("label").alias("predicted"))
    rows = found.join(asked.select("id", F.col("label").alias("expected")), "id").join(labels, "nearest_id")
    grp = F.when(F.col("width") == 32, "base").otherwise("full")
    return rows.select(grp.alias("grp"), (F.col("id") % 3).alias("seed"), "id", "expected", F.when(F.col("id") % 17 != 5, F.col("predicted")).alias("predicted"))


_PREDICTIONS = """
WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (
  SELECT g.grp, q.id, q.label AS expected, s.id AS sid, s.label AS predicted,
    row_number() OVER (PARTITION BY g.grp, q.id ORDER BY round(list_cosine_similarity(q.e[1:g.dims], s.e[1:g.dims]), 9) DESC, s.id) AS k
  FROM (VALUES ('base', 32), ('full', 64)) AS g(grp, dims), v q, v s WHERE q.id % 10 <> 0 AND s.id % 10 = 0),
r AS (SELECT grp, id % 3 AS seed, id, expected, CASE WHEN id % 17 <> 5 THEN predicted END AS predicted FROM p WHERE k = 1)
"""


def accuracy_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _predictions(spark, d), table(spark, d, "embeddings").select("label").distinct()
    catalogue = labels.union(spark.sql("SELECT 99 AS label"))  # a label without rows counts as 0
    found = scoring.accuracy(rows, "grp", "seed").join(scoring.macro_f1(rows, catalogue, "grp", "seed"), ["grp", "seed"])
    return found.select("grp", "seed", "n", *[F.round(c, 9).alias(c) for c in ("valid_rate", "accuracy", "macro_f1")])


def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _predictions(spark, d)
    return scoring.accuracy(rows, "grp", "expected").select("grp", "expected", "n", F.round("accuracy", 9).alias("accuracy"))


def confusion_topk(spark: SparkSession, d: str) -> DataFrame:
    """The labels that the hardest label (least accuracy over all answers, ties by label) is taken for, at most six a model and seed."""
    answers = _predictions(spark, d)
    hardest = scoring.accuracy(answers, "expected").orderBy("accuracy", "expected").limit(1).select(F.col("expected").alias("hardest"))
    rows = answers.join(F.broadcast(hardest), F.col("expected") == F.col("hardest"))
    flow = rows.groupBy("grp", "seed", F.coalesce(F.col("predicted").cast("string"), F.lit("<unparseable>")).alias("predicted")).agg(F.count("*").alias("n"), F.min("id").alias("first_seen"))
    w = Window.partitionBy("grp", "seed").orderBy(F.col("n").desc(), "first_seen")
    return flow.select("grp", "seed", "predicted", "n", F.row_number().over(w).cast("long").alias("place")).where("place <= 6")


def per_label_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over seeds of the paired difference between the two models, by label."""
    rows = scoring.accuracy(_predictions(spark, d), "grp", "seed", "expected")
    wide = rows.groupBy("seed", "expected").pivot("grp", ["base", "full"]).agg(F.first("accuracy"))
    delta = wide.select("seed", "expected", (100 * (F.col("full") - F.col("base"))).alias("delta"))
    return delta.groupBy("expected").agg(F.count("*").alias("seeds"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_samp("delta"), 6).alias("sd"), F.round(F.max("delta") - F.min("delta"), 6).alias("range"))


def kind_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by model and kind of row, with the total over kinds."""
    rows = _predictions(spark, d).withColumn("kind", F.element_at(F.array(*map(F.lit, ("colloquial", "lexical", "asr_noise"))), (F.col("id") % 3 + 1).cast("int")))
    hit = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("double")
    totals = rows.withColumn("hit", hit).rollup("grp", "kind").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("accuracy"))
    return totals.where("level < 3").select("grp", F.coalesce("kind", F.lit("all")).alias("kind"), "n", "accuracy")


def replicate_t_interval(spark: SparkSession, d: str) -> DataFrame:
    by_seed = scoring.accuracy(_predictions(spark, d), "grp", "seed")
    stats = by_seed.groupBy("grp").agg(F.count("*").alias("seeds"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"))
    low, high = t_interval(F.col("mean"), F.col("sd"))
    return stats.select("grp", "seeds", *[F.round(c, 9).alias(n) for n, c in (("mean", F.col("mean")), ("sd", F.col("sd")), ("low", low), ("high", high))])


def wilson_by_group(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    sizing, _ = wilson(F.col("k"), F.col("n"), Z_SIZING)
    return labels.select("lang", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(sizing, 9).alias("sizing_low"))


def generation_sizing(spark: SparkSession, d: str) -> DataFrame:
    rows = wilson_by_group(spark, d)
    required, fits, enough = planning.sizing(F.col("sizing_low"), F.lit(8000.0), F.lit(1.287466431), F.lit(18000.0))
    return rows.select("lang", required.alias("required"), fits.alias("fits"), enough.alias("enough"))


def _discordant(spark: SparkSession, d: str) -> DataFrame:
    wide = _predictions(spark, d).withColumn("hit", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))).groupBy("seed", "id").pivot("grp", ["base", "full"]).agg(F.first("hit"))
    return wide.groupBy("seed").agg(F.count_if(F.expr("base AND NOT full")).alias("base_only"), F.count_if(F.expr("full AND NOT base")).alias("full_only"))


def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return _discordant(spark, d)


def mcnemar_holm(spark: SparkSession, d: str) -> DataFrame:
    tests = _discordant(spark, d).withColumn("p", mcnemar_p(F.col("base_only"), F.col("full_only")))
    return tests.select("seed", F.round("p", 9).alias("p"), F.round(holm(F.col("p")), 9).alias("holm_p"))


def holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Step-down adjustment of p-values that come from the shares of the order priorities."""
    shares = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg((F.count("*") / 1e6).alias("p"))
    return shares.select("o_orderstatus", "o_orderpriority", F.round("p", 9).alias("p"), F.round(holm(F.col("p"), "o_orderstatus"), 9).alias("holm_p"))


def gap_closed_by_label(spark: SparkSession, d: str) -> DataFrame:
    """How far the larger model goes from the smaller one's accuracy to 1, by label."""
    wide = scoring.accuracy(_predictions(spark, d), "grp", "expected").groupBy("expected").pivot("grp", ["base", "full"]).agg(F.first("accuracy"))
    return wide.select("expected", F.round(gap_closed(F.col("full"), F.col("base"), F.lit(1.0)), 6).alias("gap_closed"))


def label_movement(spark: SparkSession, d: str) -> DataFrame:
    """The labels that gain most and least, three each."""
    wide = scoring.accuracy(_predictions(spark, d), "grp", "expected").groupBy("expected").pivot("grp", ["base", "full"]).agg(F.first("accuracy"))
    delta = wide.select("expected", F.round(F.col("full") - F.col("base"), 9).alias("delta"))
    up, down = Window.orderBy(F.col("delta").desc(), "expected"), Window.orderBy("delta", F.col("expected").desc())
    ranked = delta.withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)})
    return ranked.where("up <= 3 OR down <= 3").select("expected", "delta", (F.col("up") <= 3).alias("gains"))


def slot_micro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Words of a part's type against the words of its name, as multisets, by brand."""
    part = table(spark, d, "part")
    words = lambda c: F.explode(F.split(F.lower(c), " ")).alias("word")
    expected, given = part.select("p_brand", "p_partkey", words(F.col("p_type"))), part.select("p_brand", "p_partkey", words(F.col("p_name")))
    counts = scoring.slot_counts(expected, given, "p_brand")
    return counts.select("p_brand", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.round(scoring.micro_f1(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f1"))


def token_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Linear and nearest-rank percentiles of document lengths, the longest, and how many have its length, by language."""
    docs = table(spark, d, "documents").select("lang", "n_chars", "doc_id")
    rows = ranked_within(docs, "lang", "n_chars", "doc_id", name="i", start=0, size="n")
    near = lambda f: F.max(F.when(F.col("i") == F.bround(F.lit(f) * (F.col("n") - 1), 0), F.col("n_chars")))
    # A linear percentile lies between the rows on both sides of its place.
    at = F.lit(0.95) * (F.col("n") - 1)
    side = lambda place: F.max(F.when(F.col("i") == place, F.col("n_chars")))
    low, high, part = side(F.floor(at)), side(F.ceil(at)), F.max(at - F.floor(at))
    found = rows.groupBy("lang").agg(F.round(low + (high - low) * part, 6).alias("p95"), near(0.95).alias("near95"), near(0.5).alias("near50"), F.max("n_chars").alias("longest"))
    limit = rows.groupBy("lang", "n_chars").agg(F.count("*").alias("n")).groupBy("lang").agg(F.max_by("n", "n_chars").alias("at_longest"))
    return found.join(limit, "lang")


def plan_allocation(spark: SparkSession, d: str) -> DataFrame:
    """As many requests as there are orders, by recipe."""
    return planning.allocation(spark, table(spark, d, "orders").count())


def slot_substitution_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Brand and size of each part as slots; the first that has a substitute."""
    part = table(spark, d, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))
    slots = part.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("row_pos"), text.alias("text"), F.posexplode(F.array(F.struct(F.lit("size").alias("type"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("value")))).alias("slot_pos", "s")).select("row_id", "row_pos", "slot_pos", "text", "s.type", "s.value")
    return planning.first_substitutions(slots)


def cycled_plan(spark: SparkSession, d: str) -> DataFrame:
    pool = ranked(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", name="pos", start=0).drop("s_suppkey")
    return planning.cycled(pool, table(spark, d, "customer").count(), 311).select("idx", "s_name", "style")


def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    """Of the places up to the last order's, those without a finished order."""
    orders = table(spark, d, "orders")
    n = orders.agg(F.coalesce(F.max("o_orderkey") + 1, F.lit(0)).alias("n")).first().n
    return planning.missing_indices(spark, n, orders.where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    part = ranked(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", name="pos", start=0)
    text = F.concat(F.lit("請幫我查詢"), "p_brand", F.lit("的價格，今天要在開店時知道"))
    return part.select("pos", F.col("p_partkey").cast("string").alias("id"), text.alias("utt"), F.lit("find").alias("intent"), F.array(F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("value"))).alias("slots"))


def augmented_examples(spark: SparkSession, d: str) -> DataFrame:
    return augmentation.augmented(_examples(spark, d), 200)


def robustness_probes(spark: SparkSession, d: str) -> DataFrame:
    return augmentation.probes(_examples(spark, d))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    wide = _predictions(spark, d).withColumn("hit", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("int")).groupBy("seed", "id").pivot("grp", ["base", "full"]).agg(F.first("hit"))
    return bootstrap.interval(bootstrap.deltas(wide.select("seed", F.col("base").alias("base_hit"), F.col("full").alias("new_hit")), 1000))


QUERIES = {f.__name__: f for f in (nearest_seed, nearest_nonself_quantiles, similarity_histogram, semantic_decisions, exclusion_log, accuracy_macro_f1, label_accuracy, confusion_topk, per_label_spread, kind_rollup, replicate_t_interval, wilson_by_group, generation_sizing, mcnemar_counts, mcnemar_holm, holm_adjusted, gap_closed_by_label, label_movement, slot_micro_f1, token_percentiles, plan_allocation, slot_substitution_first_match, cycled_plan, resume_missing, augmented_examples, robustness_probes, bootstrap_interval)}

_NEAREST = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id, r.id AS rid, round(list_cosine_similarity(q.e, r.e), 9) AS x FROM v q, v r WHERE {}),
n AS (SELECT id, max(x) AS similarity, min_by(rid, (-x, rid)) AS nearest_id FROM s GROUP BY id)
"""
_WILSON = "(((k/n) + {z}*{z}/(2*n)) {s} {z}*sqrt((k/n)*(1-k/n)/n + {z}*{z}/(4.0*n*n))) / (1 + {z}*{z}/n)"
_W = "WITH g AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang)"
_ACC = "acc AS (SELECT grp, expected, avg(coalesce(expected = predicted, false)::INT::DOUBLE) AS accuracy FROM r GROUP BY ALL), w AS (SELECT expected, max(accuracy) FILTER (grp = 'base') AS base, max(accuracy) FILTER (grp = 'full') AS full_ FROM acc GROUP BY expected)"
_DECIDED = """
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT id, e, row_number() OVER (ORDER BY id) AS i FROM v WHERE id % 10 >= 2),
ms AS (SELECT c.id, max(round(list_cosine_similarity(c.e, v.e), 9)) AS max_seed FROM c, v WHERE v.id % 10 = 0 GROUP BY c.id),
me AS (SELECT c.id, max(round(list_cosine_similarity(c.e, v.e), 9)) AS max_eval, min_by(v.id, (-round(list_cosine_similarity(c.e, v.e), 9), v.id)) AS nearest_eval_id FROM c, v WHERE v.id % 10 = 1 GROUP BY c.id),
t AS (SELECT c.id, c.e, c.i, max_seed, max_eval, nearest_eval_id, max_seed < 0.45 AND max_seed > 0.25 AND max_eval < 0.45 AS good FROM c JOIN ms USING (id) JOIN me USING (id)),
pr AS (SELECT b.i AS late, a.i AS early, round(list_cosine_similarity(a.e, b.e), 9) AS x FROM t a, t b WHERE a.i < b.i AND a.good),
f(i, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT t.i, CASE WHEN t.good AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.late = t.i AND pr.x >= 0.35 AND list_contains(f.taken, pr.early)) THEN list_append(f.taken, t.i) ELSE f.taken END
  FROM f JOIN t ON t.i = f.i + 1),
final AS (SELECT arg_max(taken, i) AS taken FROM f),
mp AS (SELECT late AS i, max(x) AS max_prior FROM pr, final WHERE list_contains(taken, early) GROUP BY late),
o AS (SELECT id, coalesce(max_prior, -1.0) AS max_prior, max_seed, max_eval, nearest_eval_id FROM t LEFT JOIN mp USING (i)),
dec AS (SELECT *, CASE WHEN max_prior >= 0.35 THEN 'F5_DUP_SYNTHETIC' WHEN max_seed >= 0.45 THEN 'F5_DUP_SEED' WHEN max_seed <= 0.25 THEN 'F5_OUTLIER_SEED' WHEN max_eval >= 0.45 THEN 'F6_CONTAM_EVAL' END AS reject_reason FROM o)
"""

SQL = {
    "nearest_seed": _NEAREST.format("q.id % 10 >= 2 AND r.id % 10 = 0") + "SELECT id, round(similarity, 6) AS similarity, nearest_id FROM n",
    "nearest_nonself_quantiles": _NEAREST.format("q.id <> r.id") + "SELECT k::DOUBLE AS quantile, round(quantile_cont(similarity, k::DOUBLE), 6) AS value FROM n, (VALUES (0.0), (0.01), (0.05), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99), (1.0)) AS q(k) GROUP BY k".replace("quantile_cont(similarity, k::DOUBLE)", "list_extract(any_value(a), any_value(j)::BIGINT)").replace("FROM n, (VALUES (0.0), (0.01), (0.05), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99), (1.0)) AS q(k)", "FROM (SELECT quantile_cont(similarity, [0.0::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE]) AS a FROM n), (VALUES (1, 0.0), (2, 0.01), (3, 0.05), (4, 0.25), (5, 0.5), (6, 0.75), (7, 0.9), (8, 0.95), (9, 0.99), (10, 1.0)) AS q(j, k)"),
    "similarity_histogram": _NEAREST.format("q.id % 10 >= 2 AND r.id % 10 = 0") + "SELECT CASE WHEN round(similarity, 6) < 0 THEN 0 WHEN round(similarity, 6) >= 1 THEN 36 ELSE floor(round(similarity, 6) * 35)::BIGINT + 1 END AS bucket, count(*) AS n FROM n GROUP BY 1",
    "semantic_decisions": _DECIDED + "SELECT id, reject_reason, round(max_prior, 6) AS max_prior, round(max_seed, 6) AS max_seed, round(max_eval, 6) AS max_eval, nearest_eval_id FROM dec",
    "exclusion_log": _DECIDED + "SELECT id AS sample_id, round(max_eval, 6) AS similarity, nearest_eval_id AS matched_eval_id, CASE WHEN nearest_eval_id % 4 = 1 THEN 'validation' ELSE 'test' END AS split FROM dec WHERE reject_reason = 'F6_CONTAM_EVAL'",
    "accuracy_macro_f1": _PREDICTIONS + """
, lab AS (SELECT DISTINCT label FROM embeddings UNION ALL SELECT 99), g AS (SELECT DISTINCT grp, seed FROM r),
f AS (SELECT g.grp, g.seed, lab.label, (SELECT count(*) FROM r WHERE r.grp = g.grp AND r.seed = g.seed AND expected = label) AS e, (SELECT count(*) FROM r WHERE r.grp = g.grp AND r.seed = g.seed AND predicted = label) AS p, (SELECT count(*) FROM r WHERE r.grp = g.grp AND r.seed = g.seed AND predicted = label AND expected = label) AS t FROM g, lab),
m AS (SELECT grp, seed, avg(coalesce(2.0 * t / nullif(e + p, 0), 0)) AS macro_f1 FROM f GROUP BY ALL)
SELECT r.grp, r.seed, count(*) AS n, round(avg((predicted IS NOT NULL)::INT::DOUBLE), 9) AS valid_rate, round(avg(coalesce(expected = predicted, false)::INT::DOUBLE), 9) AS accuracy, round(any_value(macro_f1), 9) AS macro_f1 FROM r JOIN m ON m.grp = r.grp AND m.seed = r.seed GROUP BY r.grp, r.seed
""",
    "label_accuracy": _PREDICTIONS + "SELECT grp, expected, count(*) AS n, round(avg(coalesce(expected = predicted, false)::INT::DOUBLE), 9) AS accuracy FROM r GROUP BY grp, expected",
    "confusion_topk": _PREDICTIONS + "SELECT grp, seed, predicted, n, place FROM (SELECT *, row_number() OVER (PARTITION BY grp, seed ORDER BY n DESC, first_seen) AS place FROM (SELECT grp, seed, coalesce(predicted::VARCHAR, '<unparseable>') AS predicted, count(*) AS n, min(id) AS first_seen FROM r WHERE expected = (SELECT expected FROM r GROUP BY expected ORDER BY avg(coalesce(expected = predicted, false)::INT::DOUBLE), expected LIMIT 1) GROUP BY ALL)) WHERE place <= 6",
    "per_label_spread": _PREDICTIONS + ", a AS (SELECT grp, seed, expected, avg(coalesce(expected = predicted, false)::INT::DOUBLE) AS acc FROM r GROUP BY ALL), x AS (SELECT seed, expected, 100 * (max(acc) FILTER (grp = 'full') - max(acc) FILTER (grp = 'base')) AS delta FROM a GROUP BY ALL) SELECT expected, count(*) AS seeds, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(max(delta) - min(delta), 6) AS range FROM x GROUP BY expected",
    "kind_rollup": _PREDICTIONS + ", k AS (SELECT *, ['colloquial', 'lexical', 'asr_noise'][id % 3 + 1] AS kind FROM r) SELECT grp, coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(coalesce(expected = predicted, false)::INT::DOUBLE), 9) AS accuracy FROM k GROUP BY GROUPING SETS ((grp, kind), (grp))",
    "replicate_t_interval": _PREDICTIONS + ", a AS (SELECT grp, seed, avg(coalesce(expected = predicted, false)::INT::DOUBLE) AS acc FROM r GROUP BY ALL) SELECT grp, count(*) AS seeds, round(avg(acc), 9) AS mean, round(stddev_samp(acc), 9) AS sd, round(avg(acc) - 4.302652729696142 * stddev_samp(acc) / sqrt(3), 9) AS low, round(avg(acc) + 4.302652729696142 * stddev_samp(acc) / sqrt(3), 9) AS high FROM a GROUP BY grp",
    "wilson_by_group": _W + f" SELECT lang, n, k, round({_WILSON.format(z='1.959963984540054::DOUBLE', s='-')}, 9) AS low, round({_WILSON.format(z='1.959963984540054::DOUBLE', s='+')}, 9) AS high, round({_WILSON.format(z='1.96::DOUBLE', s='-')}, 9) AS sizing_low FROM g",
    "generation_sizing": _W + f", w AS (SELECT lang, round({_WILSON.format(z='1.96::DOUBLE', s='-')}, 9) AS low FROM g) SELECT lang, ceil(8000 / low)::BIGINT AS required, floor(18000 / 1.287466431::DOUBLE)::BIGINT AS fits, ceil(8000 / low) <= floor(18000 / 1.287466431::DOUBLE) AS enough FROM w",
    "mcnemar_holm": _PREDICTIONS + ", h AS (SELECT seed, id, bool_or(coalesce(expected = predicted, false)) FILTER (grp = 'base') AS b, bool_or(coalesce(expected = predicted, false)) FILTER (grp = 'full') AS f FROM r GROUP BY ALL) , c AS (SELECT seed, count(*) FILTER (b AND NOT f) AS base_only, count(*) FILTER (f AND NOT b) AS full_only FROM h GROUP BY seed), pv AS (SELECT seed, least(1.0, 2 * list_sum(list_transform(range(0, least(base_only, full_only) + 1), lambda k: exp(lgamma(base_only + full_only + 1) - lgamma(k + 1) - lgamma(base_only + full_only - k + 1) - (base_only + full_only) * ln(2))))) AS p FROM c), k AS (SELECT *, row_number() OVER (ORDER BY p) AS j, count(*) OVER () AS m FROM pv) SELECT seed, round(p, 9) AS p, round(max(least(1.0, (m - j + 1) * p)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 9) AS holm_p FROM k",
    "mcnemar_counts": _PREDICTIONS + ", h AS (SELECT seed, id, bool_or(coalesce(expected = predicted, false)) FILTER (grp = 'base') AS b, bool_or(coalesce(expected = predicted, false)) FILTER (grp = 'full') AS f FROM r GROUP BY ALL) SELECT seed, count(*) FILTER (b AND NOT f) AS base_only, count(*) FILTER (f AND NOT b) AS full_only FROM h GROUP BY seed",
    "holm_adjusted": "WITH s AS (SELECT o_orderstatus, o_orderpriority, count(*) / 1e6 AS p FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) AS j, count(*) OVER (PARTITION BY o_orderstatus) AS m FROM s) SELECT o_orderstatus, o_orderpriority, round(p, 9) AS p, round(max(least(1.0, (m - j + 1) * p)) OVER (PARTITION BY o_orderstatus ORDER BY p ROWS UNBOUNDED PRECEDING), 9) AS holm_p FROM k",
    "gap_closed_by_label": _PREDICTIONS + f", {_ACC} SELECT expected, round(CASE WHEN abs(1 - base) >= 0.01 THEN 100.0 * (full_ - base) / (1 - base) END, 6) AS gap_closed FROM w",
    "label_movement": _PREDICTIONS + f", {_ACC}, x AS (SELECT expected, round(full_ - base, 9) AS delta FROM w), y AS (SELECT *, row_number() OVER (ORDER BY delta DESC, expected) AS up, row_number() OVER (ORDER BY delta, expected DESC) AS down FROM x) SELECT expected, delta, up <= 3 AS gains FROM y WHERE up <= 3 OR down <= 3",
    "slot_micro_f1": "WITH e AS (SELECT p_brand, p_partkey, unnest(string_split(lower(p_type), ' ')) AS word FROM part), g AS (SELECT p_brand, p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), b AS (SELECT *, 1 AS x FROM e UNION ALL SELECT *, 0 FROM g), c AS (SELECT p_brand, p_partkey, word, sum(x) AS e, sum(1 - x) AS p FROM b GROUP BY ALL), t AS (SELECT p_brand, CAST(sum(least(e, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - e, 0)) AS BIGINT) AS fp, CAST(sum(greatest(e - p, 0)) AS BIGINT) AS fn FROM c GROUP BY p_brand) SELECT p_brand, tp, fp, fn, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 1), 9) AS f1 FROM t",
    "token_percentiles": "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, round(quantile_cont(n_chars::DOUBLE, 0.95::DOUBLE), 6) AS p95, max(n_chars) FILTER (i = round_even(0.95 * (n - 1), 0)) AS near95, max(n_chars) FILTER (i = round_even(0.5 * (n - 1), 0)) AS near50, max(n_chars) AS longest, count(*) FILTER (n_chars = (SELECT max(m.n_chars) FROM documents m WHERE m.lang = r.lang)) AS at_longest FROM r GROUP BY lang",
    "plan_allocation": "WITH s AS (SELECT recipe, (SELECT count(*) FROM orders) * w::DOUBLE AS exact FROM (VALUES ('paraphrase', 0.35), ('slot_substitution', 0.30), ('noise_codeswitch', 0.20), ('hard_negative', 0.15)) AS t(recipe, w)), r AS (SELECT recipe, floor(exact)::BIGINT AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, recipe DESC) AS k FROM s) SELECT recipe, base + (k <= (SELECT count(*) FROM orders) - (SELECT sum(base) FROM r))::BIGINT AS n FROM r",
    "slot_substitution_first_match": "WITH p AS (SELECT p_partkey AS row_id, p_name || ' ' || p_brand || ' ' || p_size AS text, p_brand, p_size::VARCHAR AS sz FROM part), s AS (SELECT row_id, text, 0 AS slot_pos, 'size' AS type, sz AS value FROM p UNION ALL SELECT row_id, text, 1, 'brand', p_brand FROM p), b AS (SELECT type, value AS replacement, min((row_id, slot_pos)) AS first_at FROM s GROUP BY ALL), m AS (SELECT s.*, b.replacement, row_number() OVER (PARTITION BY row_id ORDER BY slot_pos, first_at) AS k FROM s JOIN b USING (type) WHERE contains(text, value) AND replacement <> value AND NOT contains(text, replacement)) SELECT row_id, slot_pos, type, value, replacement FROM m WHERE k = 1",
    "cycled_plan": "SELECT idx, s_name, CASE WHEN idx % 2 = 0 THEN 'massive_like' ELSE 'tw_colloquial' END AS style FROM range((SELECT count(*) FROM customer)) t(idx) JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) ON pos = (idx + 311) % (SELECT count(*) FROM supplier)",
    "resume_missing": "SELECT i AS o_orderkey FROM range((SELECT max(o_orderkey) + 1 FROM orders)) t(i) WHERE i NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')",
}
