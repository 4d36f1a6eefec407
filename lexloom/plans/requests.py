"""Queries on plans of requests, paired statistics and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import bootstrap, planning, reports, requests
from lexloom.operators.ranks import ranked
from lexloom.sources import writers
from lexloom.sources.tables import scratch, table

PAIRS = [("ECONOMY", "SMALL"), ("LARGE", "MEDIUM"), ("PROMO", "STANDARD")]


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Parts as seeds: their size and brand are values in the text."""
    part = table(spark, d, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))
    slot = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), "p_partkey", text.alias("utt"), F.col("p_type").alias("intent"), F.array(slot("size", F.col("p_size")), slot("brand", F.col("p_brand"))).alias("slots"))
    return ranked(rows, "p_partkey", name="pos", start=0).drop("p_partkey")


def request_plan(spark: SparkSession, d: str) -> DataFrame:
    """As many requests as there are customers, over parts as seeds."""
    total = table(spark, d, "customer").count()
    plan = requests.plan(spark, total, _pool(spark, d), PAIRS)
    slots = F.array_join(F.transform("expected_slots", lambda s: F.concat_ws("=", s["type"], s["value"])), ";")
    return plan.select("recipe", "idx", "style", "expected_intent", slots.alias("expected_slots"), F.array_join("seed_ids", ",").alias("seeds"), "pair_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def _texts(recipe: str, seed: str, anchor: str = "''") -> str:
    """A template filled in SQL."""
    quoted = requests.TEMPLATES[recipe].replace("'", "''")
    styles = {k: v.replace("'", "''") for k, v in requests.STYLES.items()}
    style = f"CASE WHEN style = 'massive_like' THEN '{styles['massive_like']}' ELSE '{styles['tw_colloquial']}' END"
    return f"replace(replace(replace('{quoted}', '{{{{STYLE}}}}', {style}), '{{{{ANCHOR}}}}', {anchor}), '{{{{SEED}}}}', {seed})"


def _seed(prefix: str = "") -> str:
    one = '\'{{"type":"{0}","value":"\' || {1}{0} || \'"}}\''
    return f"""'{{"id":"' || {prefix}id || '","utt":"' || {prefix}utt || '","intent":"' || {prefix}intent || '","slots":[' || {one.format('size', prefix)} || ',' || {one.format('brand', prefix)} || ']}}'"""


REQUEST_PLAN = f"""
WITH pool AS (
  SELECT p_partkey::VARCHAR AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name || ' ' || p_brand || ' ' || p_size AS utt, p_type AS intent, p_size::VARCHAR AS size, p_brand AS brand,
    row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS nth, count(*) OVER (PARTITION BY p_type) AS many, count(*) OVER () AS n
  FROM part
), t AS (SELECT count(*) AS total FROM customer),
s AS (SELECT recipe, total * w::DOUBLE AS exact FROM t, (VALUES ('paraphrase', 0.35), ('slot_substitution', 0.30), ('noise_codeswitch', 0.20), ('hard_negative', 0.15)) AS v(recipe, w)),
c AS (SELECT recipe, floor(exact)::BIGINT + (row_number() OVER (ORDER BY exact - floor(exact) DESC, recipe DESC) <= (SELECT total FROM t) - (SELECT sum(floor(exact)) FROM s))::INT AS n FROM s),
i AS (SELECT recipe, unnest(range(n)) AS idx, CASE WHEN unnest(range(n)) % 2 = 0 THEN 'massive_like' ELSE 'tw_colloquial' END AS style FROM c),
sizes AS (SELECT size AS v, min(pos) AS first FROM pool GROUP BY size), brands AS (SELECT brand AS v, min(pos) AS first FROM pool GROUP BY brand),
sub AS (
  SELECT *, (SELECT arg_min(v, first) FROM sizes WHERE v <> size AND NOT contains(utt, v)) AS new_size, (SELECT arg_min(v, first) FROM brands WHERE v <> brand AND NOT contains(utt, v)) AS new_brand FROM pool
), drafts AS (
  SELECT id, intent, row_number() OVER (ORDER BY pos) - 1 AS pos, count(*) OVER () AS n,
    CASE WHEN new_size IS NOT NULL THEN substr(utt, 1, strpos(utt, size) - 1) || new_size || substr(utt, strpos(utt, size) + length(size)) ELSE substr(utt, 1, strpos(utt, brand) - 1) || new_brand || substr(utt, strpos(utt, brand) + length(brand)) END AS utt,
    coalesce(new_size, size) AS size, CASE WHEN new_size IS NOT NULL THEN brand ELSE new_brand END AS brand
  FROM sub WHERE new_size IS NOT NULL OR new_brand IS NOT NULL
), pairs AS (SELECT * FROM (VALUES (0, 'ECONOMY', 'SMALL'), (1, 'LARGE', 'MEDIUM'), (2, 'PROMO', 'STANDARD')) AS p(pair, a, b)),
hard AS (
  SELECT i.recipe, i.idx, i.style, a.id AS a_id, a.utt AS a_utt, a.intent AS a_intent, a.size AS a_size, a.brand AS a_brand, b.*
  FROM i JOIN pairs ON pair = idx % 3 JOIN pool a ON a.intent = pairs.a AND a.nth = (idx // 3) % a.many JOIN pool b ON b.intent = pairs.b AND b.nth = (idx // 3) % b.many WHERE i.recipe = 'hard_negative'
), r AS (
  SELECT recipe, idx, style, intent, size, brand, id AS seeds, NULL AS pair_id, {_texts('paraphrase', _seed())} AS prompt FROM i JOIN pool ON pos = idx % pool.n WHERE recipe = 'paraphrase'
  UNION ALL SELECT recipe, idx, style, intent, size, brand, id, NULL, {_texts('slot_substitution', _seed())} FROM i JOIN drafts ON pos = idx % drafts.n WHERE recipe = 'slot_substitution'
  UNION ALL SELECT recipe, idx, style, intent, size, brand, id, NULL, {_texts('noise_codeswitch', _seed())} FROM (SELECT recipe, idx, 'tw_colloquial' AS style FROM i) JOIN pool ON pos = (idx + 311) % pool.n WHERE recipe = 'noise_codeswitch'
  UNION ALL SELECT recipe, idx, style, intent, size, brand, a_id || ',' || id, 'pair_' || left(sha256(a_id || chr(0) || id), 16), {_texts('hard_negative', _seed(), _seed('a_'))} FROM hard
)
SELECT recipe, idx, style, intent AS expected_intent, 'size=' || size || ';brand=' || brand AS expected_slots, seeds, pair_id, sha256(prompt) AS prompt_sha256 FROM r
"""


def plan_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The turn of each order in a plan that is shuffled by hash."""
    return planning.scheduled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "turn")


# --- Paired statistics ----------------------------------------------------------------------------


def _model(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Orders as answers of a model, by rules on their columns: label, whether it can be read, and how two slots of each fare."""
    orders = table(spark, d, "orders")
    cheap = F.col("o_totalprice") < (150_000 if name == "base" else 90_000)
    lost = F.col("o_totalprice") > (460_000 if name == "base" else 480_000)
    predicted = F.when(lost, None).when(cheap, "1-URGENT").otherwise(F.col("o_orderpriority"))
    tp = F.when(lost, 0).otherwise(F.lit(1) + (F.col("o_custkey") % 3 == 0).cast("int"))
    given = F.when(lost, 0).when(cheap, 3).otherwise(2)
    exact = F.coalesce(predicted == F.col("o_orderpriority"), F.lit(False)) & (tp == 2) & (given == 2)
    keys = [F.month("o_orderdate").alias("seed"), "o_orderkey"]
    parts = {"expected": F.col("o_orderpriority"), "predicted": predicted, "valid": ~lost, "exact": exact, "tp": tp, "fp": given - tp, "fn": 2 - tp}
    return orders.select(*keys, *[c.alias(n) for n, c in parts.items()])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    base, new = (_model(spark, d, name) for name in ("base", "new"))
    return reports.paired(base, new, ["seed", "o_orderkey"], "expected")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of labels, with one that no row has."""
    seen = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    return seen.unionByName(spark.createDataFrame([("none",)], "label string"))


def paired_metric_points(spark: SparkSession, d: str) -> DataFrame:
    """The difference between two models by seed and metric."""
    return bootstrap.point_deltas(_pairs(spark, d), _flags(spark, d)).withColumn("delta", F.round("delta", 9))


def metric_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The middle 95 % of 500 drawn differences, by metric."""
    return bootstrap.intervals(bootstrap.metric_deltas(_pairs(spark, d), _flags(spark, d), 500))


PAIRED_METRIC_POINTS = """
WITH m AS (
  SELECT month(o_orderdate) AS seed, o_orderpriority AS expected, o_custkey, name, o_totalprice < cheap AS off, CASE WHEN o_totalprice > lost THEN NULL WHEN o_totalprice < cheap THEN '1-URGENT' ELSE o_orderpriority END AS predicted
  FROM orders, (VALUES ('base', 150000, 460000), ('new', 90000, 480000)) AS v(name, cheap, lost)
), a AS (
  SELECT *, CASE WHEN predicted IS NULL THEN 0 WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END AS tp, CASE WHEN predicted IS NULL THEN 0 WHEN off THEN 3 ELSE 2 END AS given FROM m
), s AS (
  SELECT seed, name, avg(coalesce(predicted = expected, false)::INT::DOUBLE) AS intent_accuracy, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(given - tp) + sum(2 - tp)) AS slot_micro_f1,
    avg((coalesce(predicted = expected, false) AND tp = 2 AND given = 2)::INT::DOUBLE) AS exact_match, avg((predicted IS NOT NULL)::INT::DOUBLE) AS json_valid_rate
  FROM a GROUP BY seed, name
), f AS (
  SELECT seed, name, label, count(*) FILTER (expected = label) + count(*) FILTER (predicted = label) AS seen, count(*) FILTER (expected = label AND predicted = label) AS hits
  FROM a, (SELECT DISTINCT o_orderpriority AS label FROM orders UNION ALL SELECT 'none') GROUP BY ALL
), u AS (
  SELECT seed, name, avg(CASE WHEN seen > 0 THEN 2.0::DOUBLE * hits / seen ELSE 0 END) AS intent_macro_f1 FROM f GROUP BY ALL
), l AS (
  UNPIVOT (SELECT s.*, intent_macro_f1 FROM s JOIN u ON u.seed = s.seed AND u.name = s.name) ON intent_accuracy, intent_macro_f1, slot_micro_f1, exact_match, json_valid_rate INTO NAME metric VALUE value
)
SELECT seed::INT AS seed, metric, round(max(value) FILTER (name = 'new') - max(value) FILTER (name = 'base'), 9) AS delta FROM l GROUP BY seed, metric
"""


# --- Sessions -------------------------------------------------------------------------------------


def session_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Each user's time by day, appended in two runs, and the totals after the second."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    rows = days.select(F.col("user_id").alias("session"), (F.col("micros") / 1e6).alias("seconds"), _early().alias("early"))
    out = scratch(spark, "ledger")
    writers.ledger(rows.where("early"), out)
    return writers.ledger(rows.where("NOT early"), out).withColumn("seconds", F.round("seconds", 3).cast("double"))


def _early() -> Column:
    return F.col("day") < F.lit("2024-01-10").cast("date")


QUERIES = {f.__name__: f for f in (request_plan, plan_schedule, paired_metric_points, metric_intervals, session_ledger)}

SQL = {
    "request_plan": REQUEST_PLAN,
    "plan_schedule": "SELECT o_orderkey, row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) - 1 AS turn FROM orders",
    "paired_metric_points": PAIRED_METRIC_POINTS,
    "session_ledger": "WITH x AS (SELECT user_id, ts::DATE AS day, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS s FROM events GROUP BY ALL) SELECT user_id AS session, count(*) AS runs, round(sum(s::DECIMAL(24, 6)), 3)::DOUBLE AS seconds FROM x GROUP BY user_id",
}
