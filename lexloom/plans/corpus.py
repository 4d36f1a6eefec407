"""Queries on documents and records: funnel, duplicates, contamination, samples, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.hashing import content_id, rank_hash
from lexloom.functions.text import annotated, comparison_form, filled, han_share, latin_share, substituted
from lexloom.operators import checks, funnel, sampling, scoring
from lexloom.operators.ranks import tree_digest
from lexloom.sources.tables import kept, table

#: The share of letters outside Latin script from which a document's script is unexpected, and languages that are in the catalogue.
LANGUAGES = ["de", "en", "fr"]
ANCHOR = 5
#: Benchmark items whose hashes (about 50 bytes each) are sent to all tasks; more are joined by a shuffle.
FEW_ITEMS = 500_000


def _leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the item's words stand in the document, one after the other.

    The item's first words (at most ANCHOR) are looked up among the document's runs of words by their hash. The items'
    hashes are sent to all tasks where they are few, so nothing of the documents is shuffled but the hits; only documents
    with hits are then compared as texts.
    """
    words = lambda c: F.array_remove(F.split(F.lower(c), r"\s+"), "")
    asked = items.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0).withColumn("k", F.least(F.size("iw"), F.lit(ANCHOR)))
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    asked = asked.withColumn("w", hashed(F.col("iw")))
    first = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(*[F.get("w", F.lit(j)) for j in range(k)])) for k in range(1, ANCHOR + 1)])
    asked = asked.select("item_id", "k", first.alias("key"), F.array_join("iw", " ").alias("needle"))
    sizes = {r.k: r["count"] for r in asked.groupBy("k").count().collect()}  # at most ANCHOR values
    if not sizes:
        return docs.select("doc_id").where("false").withColumn("item_id", F.lit(None).cast("long"))
    keys = asked.select("k", "key", "item_id")
    keys = F.broadcast(keys) if sum(sizes.values()) <= FEW_ITEMS else keys
    split = docs.where("text IS NOT NULL").select("doc_id", hashed(words(F.col("text"))).alias("w"))
    none = F.array().cast("array<struct<k:int,key:bigint>>")
    runs = F.concat(*[F.when(F.size("w") >= k, F.transform(_runs(k), _keyed(k))).otherwise(none) for k in sorted(sizes)])
    hits = split.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.*").join(keys, ["k", "key"]).select("doc_id", "item_id").distinct()
    met = docs.select("doc_id", "text").join(hits, "doc_id").join(asked.select("item_id", "needle"), "item_id")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return met.where(F.contains(spaced(F.array_join(words(F.col("text")), " ")), spaced(F.col("needle")))).select("doc_id", "item_id").distinct()


def _keyed(k: int):
    return lambda h: F.struct(F.lit(k).alias("k"), h.alias("key"))


def _runs(k: int):
    """Hashes of the runs of k words, of an array w of the words' hashes: taking elements costs the same at every place, slices of an array don't."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]))


def benchmark_contamination(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


BENCHMARK_CONTAMINATION = r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM benchmark)
SELECT d.doc_id, b.item_id FROM d JOIN b ON contains(d.t, b.t) WHERE length(trim(b.t)) > 0
"""


def funnel_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Reason and passed stage of each document; of equal texts (comparison form) the first passes F5."""
    docs = table(spark, d, "documents")
    leaks = _leaked(docs, table(spark, d, "benchmark")).select("doc_id").distinct().withColumn("leaked", F.lit(True))
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    cheap = docs.select(
        "doc_id",
        F.sha2(comparison_form(F.coalesce("text", F.lit(""))), 256).alias("form"),
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "F1_SCHEMA_MISSING_SAMPLE")
        .when(~F.coalesce(F.col("lang").isin(LANGUAGES), F.lit(False)), "F2_LABEL_UNKNOWN_INTENT")
        .when(words < 10, "F3_UNGROUNDED_OR_OVERLAPPING_SLOT")
        .when(F.col("text").rlike(r"[#*$%&]{3}"), "F4_LOCALE_MAINLAND_TERM")
        .when(latin_share(F.col("text")) < 0.9, "F4_LOCALE_LANGUAGE_RATIO")
        .alias("early"),
    )
    cheap = kept(cheap)  # read twice: for the first of each form, and for all rows
    firsts = cheap.where("early IS NULL").groupBy("form").agg(F.min("doc_id").alias("first_id"))
    joined = cheap.join(firsts, "form", "left").join(leaks, "doc_id", "left")
    reason = F.coalesce("early", F.when(F.col("doc_id") != F.col("first_id"), "F5_DUP_SYNTHETIC"), F.when(F.col("leaked"), "F6_CONTAM_EVAL"))
    rows = joined.select("doc_id", reason.alias("reject_reason"))
    stage = F.when(F.col("reject_reason").isNull(), "F6").otherwise(F.element_at(F.array(*[F.lit(s) for s in ("none", "F1", "F2", "F3", "F4", "F5")]), F.substring("reject_reason", 2, 1).cast("int")))
    return rows.withColumn("passed_stage", stage)


FUNNEL_DECISIONS = (
    r"""
WITH b AS (SELECT ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM benchmark WHERE trim(text) <> ''),
leak AS (SELECT DISTINCT doc_id FROM documents JOIN b ON contains(' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ', b.t)),
c AS (SELECT doc_id, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\s+', '', 'g') AS form,
  CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'F1_SCHEMA_MISSING_SAMPLE'
    WHEN lang IS NULL OR lang NOT IN ('de', 'en', 'fr') THEN 'F2_LABEL_UNKNOWN_INTENT'
    WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 10 THEN 'F3_UNGROUNDED_OR_OVERLAPPING_SLOT'
    WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'F4_LOCALE_MAINLAND_TERM'
    WHEN coalesce(len(regexp_extract_all(text, '\p{Latin}'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0) < 0.9 THEN 'F4_LOCALE_LANGUAGE_RATIO' END AS early
  FROM documents),
f AS (SELECT form, min(doc_id) AS first_id FROM c WHERE early IS NULL GROUP BY form),
r AS (SELECT c.doc_id, coalesce(early, CASE WHEN c.doc_id <> first_id THEN 'F5_DUP_SYNTHETIC' WHEN leak.doc_id IS NOT NULL THEN 'F6_CONTAM_EVAL' END) AS reject_reason
  FROM c LEFT JOIN f USING (form) LEFT JOIN leak ON leak.doc_id = c.doc_id)
"""
)
_STAGE = "CASE WHEN reject_reason IS NULL THEN 'F6' WHEN substr(reject_reason, 2, 1) = '1' THEN 'none' ELSE 'F' || (substr(reject_reason, 2, 1)::INT - 1) END"


def funnel_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = funnel_decisions(spark, d)
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"), "passed_stage").agg(F.count("*").alias("n"))


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that occur more than once: how often, and the first document."""
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def exact_dup_summary(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "documents").groupBy(F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("b")).agg(F.count("*").alias("n"))
    return forms.agg(F.count("*").alias("distinct_texts"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("n") > 1).alias("groups"), F.max("n").alias("largest"))


def script_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.round(latin_share(F.col("text")), 9).alias("latin"), F.round(han_share(F.col("text")), 9).alias("han"))


def normalized_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.sum(F.length(comparison_form(F.col("text")))).cast("long").alias("chars"), F.count("*").alias("n"))


def annotation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Annotated texts made from parts, some without a bracket's end, without a value, or with a value more."""
    part = table(spark, d, "part")
    brand = F.concat(F.lit("[brand : "), F.when(F.col("p_size") == 13, " ").otherwise(F.col("p_brand")), F.lit("]"))
    size = F.concat(F.lit("[size:"), F.col("p_size").cast("string"), F.when(F.col("p_name").startswith("old"), "").otherwise("]"))
    more = F.when(F.col("p_type") == "LARGE", F.concat(F.lit(" [ name :  "), "p_name", F.lit(" ]"))).otherwise("")
    text = F.concat(brand, F.lit(" of "), size, more, F.lit(" "), F.col("p_type"))
    parsed = part.select("p_partkey", annotated(text).alias("a"))
    slots = F.array_join(F.transform("a.slots", lambda s: F.concat_ws("=", s["type"], s["value"])), ";")
    return parsed.select("p_partkey", "a.utterance", slots.alias("slots"), F.coalesce("a.error", F.lit("none")).alias("error"))


def stratified_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.per_stratum(docs, "lang", "doc_id", 20).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exactly(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100)


def equal_size_groups(spark: SparkSession, d: str) -> DataFrame:
    return sampling.equal_size(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def equal_n_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left when one group is taken out; the size at which all such sets are equal."""
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return counts.join(F.broadcast(total)).select("lang", "n", (F.col("total") - F.col("n")).alias("without"), (F.col("total") - F.col("most")).alias("equal_n"), F.round(F.col("n") / F.col("total"), 9).alias("share"))


def audit_strata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    margin = F.abs(F.col("n_chars") - 1000).cast("double")
    chosen = sampling.audit(docs, "doc_id", F.col("source") == "src7", F.col("n_chars") % 7 == 0, margin, 0.10)
    return chosen.select("doc_id", "stratum", "boundary_margin", "slot_count_changed")


def documents_contract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return checks.violations(docs, has_text=F.col("text") != "", counts_chars=F.length("text") == F.col("n_chars"), known_language=F.col("lang").isin(LANGUAGES), known_source=F.col("source").rlike("^src[0-9]+$"))


def orders_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return checks.contiguous(table(spark, d, "orders").select((F.col("o_orderkey") - F.lit(1)).alias("i")), "i")


def strict_json_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a strict parser makes of responses built from events, damaged where their values say so."""
    events = table(spark, d, "events")
    good = F.concat(F.lit('{"intent": "'), "event_type", F.lit('", "slots": [{"type": "k", "value": "'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    v = F.col("value")
    raw = (
        F.when(v < 1, F.concat(good, F.lit(" thanks")))
        .when(v < 2, F.concat(F.lit("```json"), good, F.lit("```")))
        .when(v < 3, F.replace(good, F.lit('"slots"'), F.lit('"extra": 1, "slots"')))
        .when(v < 4, F.replace(good, F.lit('"type": "k"'), F.lit('"type": "z"')))
        .when(v < 5, F.replace(good, F.lit('{"intent": "'), F.lit('{"intent": "no_')))
        .when(v < 6, F.replace(good, F.concat(F.lit('"'), "event_type", F.lit('"')), F.lit("5")))
        .when(v < 7, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(F.concat(F.lit("  "), good, F.lit("\n")))
    )
    kinds = [r.event_type for r in events.select("event_type").distinct().collect()]  # the catalogue of labels
    parsed = events.select(scoring.strict_parse(kinds, ["k"])(raw).alias("p")).select("p.outcome")
    return scoring.outcome_counts(parsed).select("outcome", "n")


def record_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The record funnel over records made from parts, with a flaw in most."""
    part = table(spark, d, "part")
    k = F.col("p_partkey") % 8
    brand, size = F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("type"), F.col("p_size").cast("string").alias("value"))
    slots = F.when(k == 3, F.array(brand, F.struct(F.lit("colour").alias("type"), F.lit("x").alias("value")))).when(k == 4, F.array(brand, F.struct(F.lit("size").alias("type"), F.lit("not there").alias("value")))).otherwise(F.array(brand, size))
    text = F.concat(F.lit("請找"), "p_brand", F.lit("的零件尺寸"), F.col("p_size").cast("string"), F.when(k == 5, "視頻").when(k == 6, "软件").when(k == 7, "приве́т").otherwise("的商品資料還有很多相關說明可以看看"))
    sample = F.when(k != 0, F.struct(text.alias("utt"), F.when(k == 2, "unknown").otherwise("find").alias("intent"), slots.alias("slots"), F.lit("noise_codeswitch").alias("recipe")))
    expected = F.struct(F.lit("find").alias("intent"), slots.alias("slots"))
    records = part.select("p_partkey", sample.alias("sample"), expected.alias("expected"))
    return funnel.validated(records, ["find"], ["brand", "size"]).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"), F.coalesce("passed_stage", F.lit("none")).alias("passed_stage")).agg(F.count("*").alias("n"))


def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    text = filled("find {{name}} of {{brand}}", {"name": F.col("p_name"), "brand": F.col("p_brand")})
    new = substituted(text, F.col("p_brand"), F.lit("Brand#X"))
    target = F.to_json(F.struct(F.lit("find").alias("intent"), F.array(F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("value"))).alias("slots")))
    return part.select("p_partkey", text.alias("prompt"), new.alias("replaced"), target.alias("target"), content_id("syn_", F.col("p_partkey").cast("string"), target).alias("id"))


def flattened_release(spark: SparkSession, d: str) -> DataFrame:
    """Documents judged good enough: rows with a bad verdict are left out, unjudged ones kept."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    bad = labels.where("toxic = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def row_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each language's texts in their order, as a tree of digests."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return tree_digest(docs, F.col("text"), "doc_id", group="lang")


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9, 6).alias("hours"), F.count("*").alias("n"))


def first_seed_per_label(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(rank_hash(42, F.col("vec_id")), "vec_id")
    return table(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("n")).where("n = 1").select("label", "vec_id")


QUERIES = {f.__name__: f for f in (funnel_documents, funnel_decisions, exact_dup_groups, exact_dup_summary, benchmark_contamination, script_shares, normalized_lengths, annotation_parse, stratified_hash_sample, hash_sample, equal_size_groups, equal_n_ablation, audit_strata, documents_contract, orders_contiguity, strict_json_outcomes, record_funnel, prompt_rendering, flattened_release, row_digests, latest_event, first_seed_per_label)}

SQL = {
    "funnel_documents": FUNNEL_DECISIONS + f"SELECT coalesce(reject_reason, 'accepted') AS outcome, {_STAGE} AS passed_stage, count(*) AS n FROM r GROUP BY ALL",
    "funnel_decisions": FUNNEL_DECISIONS + f"SELECT doc_id, reject_reason, {_STAGE} AS passed_stage FROM r",
    "exact_dup_groups": "SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "exact_dup_summary": "SELECT count(*) AS distinct_texts, CAST(sum(n - 1) AS BIGINT) AS repeats, count(*) FILTER (n > 1) AS groups, max(n) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY text)",
    "benchmark_contamination": BENCHMARK_CONTAMINATION,
    "script_shares": r"SELECT doc_id, round(coalesce(len(regexp_extract_all(text, '\p{Latin}'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0), 9) AS latin, round(coalesce(len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{L}')), 0), 0), 9) AS han FROM documents",
    "normalized_lengths": r"SELECT lang, CAST(sum(length(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', '', 'g'))) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY lang",
    "annotation_parse": r"""
WITH t AS (
  SELECT p_partkey, '[brand : ' || CASE WHEN p_size = 13 THEN ' ' ELSE p_brand END || '] of [size:' || p_size || CASE WHEN starts_with(p_name, 'old') THEN '' ELSE ']' END ||
    CASE WHEN p_type = 'LARGE' THEN ' [ name :  ' || p_name || ' ]' ELSE '' END || ' ' || p_type AS text
  FROM part
), a AS (
  SELECT *, regexp_replace(text, '\[\s*([^\[\]:]+?)\s*:\s*(.*?)\s*\]', '\2', 'g') AS utterance,
    list_transform(regexp_extract_all(text, '\[\s*[^\[\]:]+?\s*:\s*.*?\s*\]'), lambda x: [trim(string_split(x[2:-2], ':')[1]), trim(array_to_string(string_split(x[2:-2], ':')[2:], ':'))]) AS found
  FROM t
)
SELECT p_partkey, utterance, array_to_string(list_transform(found, lambda x: x[1] || '=' || x[2]), ';') AS slots,
  CASE WHEN len(list_filter(found, lambda x: x[2] = '')) > 0 THEN 'empty slot' WHEN regexp_matches(utterance, '[\[\]]') THEN 'unread bracket' ELSE 'none' END AS error
FROM a
""",
    "stratified_hash_sample": "SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20",
    "hash_sample": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY sha256('42:sample:' || c_custkey), c_custkey LIMIT 100",
    "equal_size_groups": "WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:equal:' || c_custkey), c_custkey) AS k FROM customer), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM r, m WHERE k <= least GROUP BY c_mktsegment",
    "equal_n_ablation": "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM c) SELECT lang, n, total - n AS without, total - most AS equal_n, round(n / total, 9) AS share FROM c, t",
    "audit_strata": """
WITH r AS (SELECT doc_id, source = 'src7' AS hard, n_chars % 7 = 0 AS changed, abs(n_chars - 1000)::DOUBLE AS margin FROM documents),
t AS (SELECT greatest(ceil(count(*) * 0.10), count(*) FILTER (hard)) - count(*) FILTER (hard) AS open FROM r),
c AS (SELECT r.*, open, row_number() OVER (ORDER BY NOT changed, margin, sha256('42:conflict:' || doc_id), doc_id) AS k FROM r, t WHERE NOT hard),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('42:random:' || doc_id), doc_id) AS j FROM c WHERE k > ceil(open / 2))
SELECT doc_id, 'hard_negative' AS stratum, margin AS boundary_margin, changed AS slot_count_changed FROM r WHERE hard
UNION ALL SELECT doc_id, 'boundary_conflict', margin, changed FROM c WHERE k <= ceil(open / 2)
UNION ALL SELECT doc_id, 'random', margin, changed FROM o WHERE j <= open - ceil(open / 2)
""",
    "documents_contract": r"""
SELECT * FROM (
  SELECT 'has_text' AS rule, count(*) FILTER (NOT coalesce(text <> '', false)) AS n FROM documents
  UNION ALL SELECT 'counts_chars', count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) FROM documents
  UNION ALL SELECT 'known_language', count(*) FILTER (NOT coalesce(lang IN ('de', 'en', 'fr'), false)) FROM documents
  UNION ALL SELECT 'known_source', count(*) FILTER (NOT coalesce(regexp_matches(source, '^src[0-9]+$'), false)) FROM documents
) WHERE n > 0
""",
    "orders_contiguity": "SELECT count(*) AS n, coalesce(min(o_orderkey) = 1 AND max(o_orderkey) = count(*) AND count(DISTINCT o_orderkey) = count(*), true) AS contiguous FROM orders",
    "strict_json_outcomes": """
WITH g AS (SELECT event_type, value AS v, '{"intent": "' || event_type || '", "slots": [{"type": "k", "value": "' || (props->>'$.k') || '"}]}' AS good FROM events),
r AS (SELECT CASE WHEN v < 1 THEN good || ' thanks' WHEN v < 2 THEN '```json' || good || '```' WHEN v < 3 THEN replace(good, '"slots"', '"extra": 1, "slots"') WHEN v < 4 THEN replace(good, '"type": "k"', '"type": "z"')
  WHEN v < 5 THEN replace(good, '{"intent": "', '{"intent": "no_') WHEN v < 6 THEN replace(good, '"' || event_type || '"', '5') WHEN v < 7 THEN '[' || good || ']' ELSE '  ' || good || chr(10) END AS raw FROM g),
j AS (SELECT CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r),
e AS (SELECT CASE WHEN j IS NULL THEN 'json_decode_error' WHEN json_type(j) <> 'OBJECT' OR list_sort(json_keys(j)) <> ['intent', 'slots'] OR json_type(j, '$.intent') <> 'VARCHAR' OR json_type(j, '$.slots') <> 'ARRAY' THEN 'schema_validation_error'
  WHEN j->>'$.intent' NOT IN (SELECT event_type FROM events) THEN 'unknown_intent' WHEN j->>'$.slots[0].type' <> 'k' THEN 'unknown_slot_type' ELSE 'valid' END AS outcome FROM j)
SELECT o.outcome, count(e.outcome) AS n FROM (VALUES ('valid'), ('json_decode_error'), ('unknown_intent'), ('unknown_slot_type'), ('schema_validation_error')) AS o(outcome) LEFT JOIN e USING (outcome) GROUP BY o.outcome
""",
    "record_funnel": """
WITH o(k, outcome, passed_stage) AS (VALUES (0, 'F1_SCHEMA_MISSING_SAMPLE', 'none'), (1, 'accepted', 'F4'), (2, 'F2_LABEL_UNKNOWN_INTENT', 'F1'), (3, 'F2_LABEL_UNKNOWN_SLOT', 'F1'),
  (4, 'F3_UNGROUNDED_OR_OVERLAPPING_SLOT', 'F2'), (5, 'F4_LOCALE_MAINLAND_TERM', 'F3'), (6, 'F4_LOCALE_SIMPLIFIED', 'F3'), (7, 'F4_LOCALE_UNEXPECTED_SCRIPT', 'F3'))
SELECT outcome, passed_stage, count(*) AS n FROM part JOIN o ON k = p_partkey % 8 GROUP BY ALL
""",
    "prompt_rendering": """
WITH p AS (SELECT p_partkey, 'find ' || p_name || ' of ' || p_brand AS prompt, p_brand, '{"intent":"find","slots":[{"type":"brand","value":"' || p_brand || '"}]}' AS target FROM part)
SELECT p_partkey, prompt, substr(prompt, 1, strpos(prompt, p_brand) - 1) || 'Brand#X' || substr(prompt, strpos(prompt, p_brand) + length(p_brand)) AS replaced, target, 'syn_' || left(sha256(p_partkey || ':' || target), 20) AS id FROM p
""",
    "flattened_release": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang",
    "row_digests": """
WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, sha256(coalesce(text, '')) AS h FROM documents),
a AS (SELECT lang, n, i // 1024 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, chr(10) ORDER BY r.i)) ELSE any_value(h) END AS h FROM r GROUP BY lang, n, r.i // 1024),
b AS (SELECT lang, n, i // 1024 AS i, CASE WHEN n > 1024 THEN sha256(string_agg(h, chr(10) ORDER BY a.i)) ELSE any_value(h) END AS h FROM a GROUP BY lang, n, a.i // 1024)
SELECT lang, n, CASE WHEN n > 1024 * 1024 THEN sha256(string_agg(h, chr(10) ORDER BY i)) ELSE any_value(h) END AS digest FROM b GROUP BY lang, n
""",
    "latest_event": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours, count(*) AS n FROM events GROUP BY user_id",
    "first_seed_per_label": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) AS n FROM embeddings) WHERE n = 1",
}
