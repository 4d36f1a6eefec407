"""Queries on contracts of groups, labels and reports, on examples and archives, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import contracts, plugins, reports, scoring, similarity
from lexloom.plans.models import _vectors
from lexloom.plans.reports import _answers
from lexloom.sources import examples
from lexloom.sources.tables import scratch, table


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def group_contract(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the documents of each source."""
    return contracts.observed(_grouped(spark, d), "source", "doc_id", "lang", F.col("text"))


def contract_drift(spark: SparkSession, d: str) -> DataFrame:
    """Sources against a state in which toxic documents hadn't been found: which parts differ."""
    rows, labels = _grouped(spark, d), table(spark, d, "labels")
    now = rows.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    frozen, seen = (contracts.observed(r, "source", "doc_id", "lang", F.col("text")) for r in (rows, now))
    return contracts.drift(seen, frozen, "source", "rows", "unique_ids", "least", "digest").select("source", "part", F.when(F.col("part") != "digest", F.col("was")).alias("was"), F.when(F.col("part") != "digest", F.col("is")).alias("is"))


def equal_additions(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each order priority has beyond the first one's, and whether all have as many."""
    sizes = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("rows"))
    return contracts.additions(sizes, "o_orderpriority", "1-URGENT", ["2-HIGH", "3-MEDIUM", "5-LOW"])


def label_drift(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events in the second half of the time against those of the first, and one that was known before."""
    events = table(spark, d, "events")
    early = [r.event_type for r in events.where("event_id % 2 = 0").select("event_type").distinct().collect()]
    return contracts.label_drift(events.where("value < 20").select("event_type"), "event_type", [*early, "hover"])


def complete_reports(spark: SparkSession, d: str) -> DataFrame:
    """Customers as reports: as many orders done as were asked for; which are whole."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("target"), F.count_if(F.col("o_orderstatus") != "O").alias("completed"), F.min("o_orderstatus").alias("mode"))
    return orders.select("o_custkey", contracts.complete(orders, "F").alias("complete"), contracts.complete(orders, "F", 3).alias("of_three"))


def unstable_labels(spark: SparkSession, d: str) -> DataFrame:
    """The three labels that move most between seeds, and those with the largest single difference."""
    acc = scoring.accuracy(_answers(spark, d), "grp", "seed", "expected")
    wide = acc.groupBy("seed", "expected").pivot("grp", ["base", "full"]).agg(F.first("accuracy"))
    by_seed = wide.select("expected", F.round(100 * F.coalesce("base", F.lit(0.0)), 6).alias("base"), F.round(100 * F.coalesce("full", F.lit(0.0)), 6).alias("new"))
    return contracts.unstable(by_seed, "expected", 3).withColumn("value", F.round("value", 6))


def top_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The ten texts that are repeated most."""
    groups = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    return groups.orderBy(F.col("n").desc(), "first_id").limit(10).select("first_id", "n", F.length("text").cast("long").alias("chars"))


def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many secrets and local paths a document has, of those that have any."""
    n = F.regexp_count("text", F.lit(reports.SECRETS)).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")


def similarity_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Of three distributions of similarity, the histogram in 35 bins, and the bin in which the 95th percentile lies."""
    v = _vectors(spark, d)
    parts = {"other": similarity.nearest(v, v, exclude_self=True)}
    for name, residue in (("seed", 0), ("eval", 1)):
        rest = v.where(F.col("id") % 10 >= 2)
        parts[name] = similarity.nearest(rest, v.where(F.col("id") % 10 == residue))
    out = None
    for name, found in parts.items():
        values = found.select(F.lit(name).alias("distribution"), F.round("similarity", 6).alias("x"))
        out = values if out is None else out.unionByName(values)
    return histogram(out, "distribution", F.col("x"), 35)


def histogram(rows: DataFrame, group: str, value: Column, bins: int) -> DataFrame:
    """(group, bucket, n, p95): counts in bins of [0, 1], 0 below and bins + 1 above, and whether the group's 95th percentile lies in one."""
    bucket = lambda c: F.width_bucket(c, F.lit(0.0), F.lit(1.0), F.lit(bins)).cast("long")
    marks = rows.groupBy(F.col(group).alias("_g")).agg(F.percentile(value, 0.95).alias("_p")).select("_g", bucket(F.round("_p", 6)).alias("_mark"))
    counts = rows.groupBy(group, bucket(value).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(marks), F.col(group) == F.col("_g")).select(group, "bucket", "n", (F.col("bucket") == F.col("_mark")).alias("p95"))


def token_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Words a second of a language, had each document taken a time by its length."""
    docs = table(spark, d, "documents")
    words = F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("long")
    sums = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(words).alias("tokens"), F.sum((F.col("n_chars") + 100) / 1000).alias("seconds"))
    rate, each, _ = reports.throughput(F.col("tokens"), F.col("seconds"), 5.0)
    rows, row_each, fits = reports.throughput(F.col("n"), F.col("seconds"), 5.0)
    return sums.select("lang", "tokens", F.round(rate, 6).alias("tokens_per_second"), F.round(row_each, 6).alias("seconds_a_row"), fits.cast("long").alias("rows_in_five_hours"))


def annotated_examples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as annotated texts with a coded label, read as examples of a split."""
    part = table(spark, d, "part")
    names = sorted(r.p_type for r in part.select("p_type").distinct().collect())
    code = F.array_position(F.array(*map(F.lit, names)), F.col("p_type")) - 1
    text = F.concat(F.lit("find [ name :  "), "p_name", F.lit(" ] of [brand: "), "p_brand", F.lit("]"))
    rows = part.select(F.col("p_partkey").alias("id"), code.cast("int").alias("intent"), text.alias("annot_utt"))
    out = examples.from_annotated(rows, names, "test:")
    return out.select("id", "utt", "intent", F.array_join(F.transform("slots", lambda s: F.concat_ws("=", s["type"], s["value"])), ";").alias("slots"))


def vector_archive(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written by role, read back with all checks, and summed up."""
    v = _vectors(spark, d)
    role = F.when(F.col("id") % 10 == 0, "seed").when(F.col("id") % 10 == 1, "eval").otherwise("pilot")
    at = F.when(F.col("id") % 10 < 2, F.floor(F.col("id") / 10)).otherwise(F.floor(F.col("id") / 10) * 8 + F.col("id") % 10 - 2)
    rows = v.select("id", role.alias("role"), at.cast("long").alias("ord"), "vec")
    out = scratch(spark, "vectors")
    examples.write_vectors(rows, out)
    back = examples.read_vectors(spark, out, ids={"seed": rows.where("role = 'seed'").select("id", "ord")})
    return back.groupBy("role").agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("long").alias("dims"), F.sum(F.col("id").cast("long") * (F.col("ord") + 1)).alias("check"))


def config_override(spark: SparkSession, d: str) -> DataFrame:
    """One key of each event's properties replaced."""
    return table(spark, d, "events").select("event_id", contracts.overridden(F.col("props"), "base", "public/model").alias("config"))


def filters_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first of three named filters that rejects them."""
    known = plugins.Filters()
    known.add("length", lambda: F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") > 20_000, "long"))
    known.add("language", lambda: F.when(F.col("lang") == "es", "unknown language"))
    known.add("secrets", lambda: reports.unsafe(F.col("text")))
    found = known.applied(table(spark, d, "documents"), "language", "length", "secrets")
    return found.groupBy("filter", "reject_reason").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_ALL = (group_contract, contract_drift, equal_additions, label_drift, complete_reports, unstable_labels, top_duplicates, secret_counts, similarity_calibration)
_ALL += (token_throughput, annotated_examples, vector_archive, config_override, filters_by_name)
QUERIES = {f.__name__: f for f in _ALL}

_OBSERVED = """
{name} AS (
  WITH g AS (SELECT source, lang, count(*) AS n FROM {rows} GROUP BY ALL),
  h AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, sha256(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sha256(sha256(text)) AS h FROM {rows}),
  t AS (SELECT source, n, i // 1024 AS j, CASE WHEN n > 1 THEN sha256(string_agg(h, chr(10) ORDER BY h.i)) ELSE any_value(h) END AS h FROM h GROUP BY source, n, h.i // 1024),
  r AS (SELECT source, CASE WHEN n > 1024 THEN sha256(string_agg(h, chr(10) ORDER BY j)) ELSE any_value(h) END AS digest FROM t GROUP BY source, n)
  SELECT g.source, sum(n)::BIGINT AS rows, (SELECT count(DISTINCT doc_id) FROM {rows} x WHERE x.source = g.source) AS unique_ids, count(*) AS labels, min(n) AS least, max(n) AS most, any_value(r.digest) AS digest
  FROM g JOIN r ON r.source = g.source GROUP BY g.source
)
"""
_WAS = "WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)," + _OBSERVED.format(name="was", rows="docs")

SQL = {
    "group_contract": _WAS + " SELECT * FROM was",
    "contract_drift": _WAS + ", clean AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))," + _OBSERVED.format(name="seen", rows="clean") + """
, x AS (SELECT coalesce(was.source, seen.source) AS source, unnest([('rows', was.rows::VARCHAR, seen.rows::VARCHAR), ('unique_ids', was.unique_ids::VARCHAR, seen.unique_ids::VARCHAR), ('least', was.least::VARCHAR, seen.least::VARCHAR), ('digest', was.digest, seen.digest)]) AS p FROM was FULL JOIN seen ON was.source = seen.source)
SELECT source, p[1] AS part, CASE WHEN p[1] <> 'digest' THEN p[2] END AS was, CASE WHEN p[1] <> 'digest' THEN p[3] END AS is FROM x WHERE p[2] IS DISTINCT FROM p[3]
""",
    "equal_additions": "WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT o_orderpriority, n - (SELECT n FROM s WHERE o_orderpriority = '1-URGENT') AS added FROM s WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW')) SELECT o_orderpriority, added, (SELECT count(DISTINCT added) = 1 AND count(*) = 3 FROM a) AS fair FROM a",
    "label_drift": """
WITH f AS (SELECT DISTINCT event_type FROM events WHERE event_id % 2 = 0 UNION SELECT 'hover'), n AS (SELECT DISTINCT event_type FROM events WHERE value < 20)
SELECT event_type, 'gone' AS problem FROM f WHERE event_type NOT IN (SELECT event_type FROM n) UNION ALL SELECT event_type, 'new' FROM n WHERE event_type NOT IN (SELECT event_type FROM f)
""",
    "complete_reports": "WITH c AS (SELECT o_custkey, count(*) AS target, count(*) FILTER (o_orderstatus <> 'O') AS done, min(o_orderstatus) AS mode FROM orders GROUP BY 1) SELECT o_custkey, mode = 'F' AND done = target AS complete, mode = 'F' AND done = target AND target = 3 AS of_three FROM c",
    "unstable_labels": """
WITH a AS (SELECT (o_orderkey % 3)::INT AS seed, CASE WHEN o_orderkey % 4 = 0 THEN 'base' ELSE 'full' END AS grp, o_orderpriority AS expected,
  coalesce(CASE WHEN o_orderkey % 9 <> 4 THEN CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END END = o_orderpriority, false)::INT::DOUBLE AS hit FROM orders),
s AS (SELECT seed, expected, round(100 * coalesce(avg(hit) FILTER (grp = 'base'), 0), 6) AS b, round(100 * coalesce(avg(hit) FILTER (grp = 'full'), 0), 6) AS f FROM a GROUP BY ALL),
l AS (SELECT expected, max(b) - min(b) AS range, max(abs(f - b)) AS swing FROM s GROUP BY expected),
x AS (SELECT 'range' AS "order", row_number() OVER (ORDER BY range DESC, expected) AS place, expected, round(range, 6) AS value FROM l UNION ALL SELECT 'swing', row_number() OVER (ORDER BY swing DESC, expected), expected, round(swing, 6) FROM l)
SELECT * FROM x WHERE place <= 3
""",
    "top_duplicates": "SELECT min(doc_id) AS first_id, count(*) AS n, length(text)::BIGINT AS chars FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, first_id LIMIT 10",
    "secret_counts": r"SELECT doc_id, len(regexp_extract_all(text, '(?i)[a-z]:[\\/](?:users|documents and settings)[\\/]|hf_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-[a-z0-9_-]{20,}')) AS n FROM documents WHERE len(regexp_extract_all(text, '(?i)[a-z]:[\\/](?:users|documents and settings)[\\/]|hf_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-[a-z0-9_-]{20,}')) > 0",
    "similarity_calibration": """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id, r.id AS rid, round(list_cosine_similarity(q.e, r.e), 9) AS x FROM v q, v r WHERE q.id <> r.id),
n AS (SELECT 'other' AS distribution, round(max(x), 6) AS x FROM s GROUP BY id UNION ALL SELECT 'seed', round(max(x), 6) FROM s WHERE id % 10 >= 2 AND rid % 10 = 0 GROUP BY id UNION ALL SELECT 'eval', round(max(x), 6) FROM s WHERE id % 10 >= 2 AND rid % 10 = 1 GROUP BY id),
b AS (SELECT distribution, CASE WHEN x < 0 THEN 0 WHEN x >= 1 THEN 36 ELSE floor(x * 35)::BIGINT + 1 END AS bucket FROM n),
p AS (SELECT distribution, round(quantile_cont(x, 0.95::DOUBLE), 6) AS p FROM n GROUP BY distribution)
SELECT b.distribution, bucket, count(*) AS n, any_value(bucket = CASE WHEN p < 0 THEN 0 WHEN p >= 1 THEN 36 ELSE floor(p * 35)::BIGINT + 1 END) AS p95 FROM b JOIN p ON p.distribution = b.distribution GROUP BY b.distribution, bucket
""",
    "token_throughput": r"WITH x AS (SELECT lang, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS tokens, sum((n_chars + 100) / 1000::DOUBLE) AS s FROM documents GROUP BY lang) SELECT lang, tokens, round(tokens / s, 6) AS tokens_per_second, round(s / n, 6) AS seconds_a_row, floor(18000 / (s / n))::BIGINT AS rows_in_five_hours FROM x",
    "annotated_examples": "SELECT 'test:' || p_partkey AS id, 'find ' || p_name || ' of ' || p_brand AS utt, p_type AS intent, 'name=' || p_name || ';brand=' || p_brand AS slots FROM part",
    "vector_archive": """
WITH v AS (SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'seed' WHEN 1 THEN 'eval' ELSE 'pilot' END AS role, len(embedding) AS dims FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY vec_id) AS place FROM v)
SELECT role, count(*) AS n, max(dims)::BIGINT AS dims, sum(vec_id * place)::BIGINT AS "check" FROM o GROUP BY role
""",
    "config_override": """SELECT event_id, '{"base":"public/model","k":' || (props->>'$.k') || '}' AS config FROM events""",
    "filters_by_name": r"""
WITH x AS (SELECT doc_id, CASE WHEN lang = 'es' THEN ['language', 'unknown language'] WHEN n_chars < 100 THEN ['length', 'short'] WHEN n_chars > 20000 THEN ['length', 'long']
  WHEN regexp_matches(text, '[a-z]:[\\/](?:users|documents and settings)[\\/]|hf_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|sk-[a-z0-9_-]{20,}', 'i') THEN ['secrets', 'secret or local path']
  WHEN contains(text, '[More Information Needed]') OR contains(text, '<!-- FILL') THEN ['secrets', 'placeholder'] END AS f FROM documents)
SELECT f[1] AS filter, f[2] AS reject_reason, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM x GROUP BY ALL
""",
}
