"""Queries on raw records, their files and their manifests, with SQL that reads the same texts on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import comparison_form, holds, simplified_count
from lexloom.operators import funnel, rebuilds, records, sampling
from lexloom.sources import manifests, tables, writers
from lexloom.sources.tables import scratch, table

INTENTS, KINDS = ["find", "order"], ["thing", "name", "size"]


# --- Texts in both scripts ------------------------------------------------------------------------


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Parts as utterances in traditional script, with slots in simplified script, other widths and case; the table decides which stand in the text."""
    part = table(spark, d, "part")
    phrase = F.when(F.col("p_type") == "ECONOMY", "我要看國語新聞").when(F.col("p_type") == "SMALL", "請開電視機").when(F.col("p_type") == "PROMO", "國語電影與電視機").otherwise("請播放新聞")
    asked = F.when(F.col("p_size") < 15, "国语新闻").when(F.col("p_size") < 30, "电视机").when(F.col("p_size") < 40, "新闻").otherwise(" ")
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", "０１２３４５６７８９")
    utt = F.concat(phrase, F.lit("　"), F.upper("p_name"), wide)
    slot = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    slots = F.array(slot("thing", asked), slot("name", F.col("p_name")), slot("size", F.when(F.col("p_brand") < "Brand#2", F.col("p_size")).otherwise(F.col("p_size") + 1).cast("string")))
    return part.select("p_partkey", utt.alias("utt"), asked.alias("asked"), slots.alias("slots"))


def grounded_in_both_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Comparison form, containment, places for all values, the contract of a request and simplified characters, per part."""
    said = _said(spark, d)
    sample = F.struct("utt", F.lit("find").alias("intent"), "slots")
    reason = F.coalesce(funnel.generation_reason(sample, F.struct(F.lit("find").alias("intent"), F.col("slots").alias("slots"))), F.lit("kept"))
    return said.select(
        "p_partkey",
        comparison_form(F.col("utt"), exact=True).alias("form"),
        holds(F.col("utt"), F.col("asked")).alias("holds"),
        funnel.grounded(F.col("utt"), F.transform(F.slice("slots", 1, 2), lambda s: s["value"])).alias("placed"),
        reason.alias("reason"),
        simplified_count(F.col("asked")).cast("long").alias("simplified"),
    )


_SAID = """
WITH p AS (
  SELECT p_partkey, p_name, p_size,
    CASE p_type WHEN 'ECONOMY' THEN '我要看國語新聞' WHEN 'SMALL' THEN '請開電視機' WHEN 'PROMO' THEN '國語電影與電視機' ELSE '請播放新聞' END AS phrase,
    CASE WHEN p_size < 15 THEN '国语新闻' WHEN p_size < 30 THEN '电视机' WHEN p_size < 40 THEN '新闻' ELSE ' ' END AS asked,
    CASE WHEN p_brand < 'Brand#2' THEN p_size ELSE p_size + 1 END AS told
  FROM part
), f AS (
  SELECT *, phrase || replace(lower(p_name), ' ', '') || p_size AS form, replace(lower(p_name), ' ', '') AS name,
    trim(translate(asked, '电视机国语闻', '電視機國語聞')) AS thing
  FROM p
)
"""


# --- Raw records ----------------------------------------------------------------------------------


def _json(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the text of a record, with flaws that follow from their columns."""
    # A record costs far more to judge than to read, and the table's few columns are few splits.
    part = tables.spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    size, number = F.col("p_size"), F.substring("p_brand", 7, 2).cast("int")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    intent = F.when(size > 46, '"resize"').when(size == 7, "5").otherwise('"find"')
    kind = F.when(number == 3, "colour").otherwise("name")
    value = F.when(size == 9, F.col("p_size").cast("string")).otherwise(quoted(F.col("p_name")))
    extra = F.when((F.col("p_type") == "PROMO") & (size < 8), '"more":1,').otherwise("")
    utt = F.when(F.col("p_name").startswith("hot") & (size < 12), "  ").otherwise(F.concat(F.lit("請找"), "p_name", F.lit("的商品資料還有更多相關的說明給我看看")))
    model = F.when((F.col("p_type") == "LARGE") & (size < 6), "").otherwise('"model":"m",')
    params = F.concat(F.lit('{"temperature":'), (number / 10).cast("string"), F.lit(',"top_p":1,"seed":'), F.col("p_partkey").cast("string"), F.lit(',"context_length":'), F.when(F.col("p_type") == "SMALL", '"4096"').otherwise("4096"), F.lit("}"))
    provenance = F.concat(F.lit('{"recipe":"noise_codeswitch",'), model, F.lit('"model_digest":"d","prompt_version":"noise_codeswitch.v2","seed_sample_id":"s","gen_params":'), params, F.lit(',"filter_score":{},"filter_stage_passed":null,"reject_reason":null,"generated_at":"2026-01-02T03:04:05"}'))
    id_ = F.concat(F.lit("syn_"), F.left(F.sha2(F.col("p_partkey").cast("string"), 256), F.when(size == 20, 19).otherwise(20)))
    sample = F.concat(F.lit("{"), extra, F.lit('"utt":'), quoted(utt), F.lit(',"intent":'), intent, F.lit(',"slots":[{"type":'), quoted(kind), F.lit(',"value":'), value, F.lit('}],"id":'), quoted(id_), F.lit(',"style":"massive_like","provenance":'), provenance, F.lit("}"))
    whole = F.when(size == 30, '{"sample":null}').otherwise(F.concat(F.lit('{"sample":'), sample, F.lit("}")))
    return part.select("p_partkey", F.concat(whole, F.when(size == 31, " and more").otherwise("")).alias("raw"))


def raw_record_errors(spark: SparkSession, d: str) -> DataFrame:
    """All paths at which a record breaks the schema, and what the funnel says of it."""
    decided = funnel.validated(records.read(_json(spark, d), "raw", INTENTS, KINDS), INTENTS, KINDS)
    paths = F.array_join(F.array_sort(F.transform("errors", lambda e: e["path"])), ",")
    return decided.select("p_partkey", paths.alias("paths"), F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"), F.coalesce("passed_stage", F.lit("none")).alias("passed_stage"))


#: The same texts, taken apart by another JSON reader.
_RAW_ERRORS = """
WITH x AS (
  SELECT p_partkey, p_name, p_size, p_type, substr(p_brand, 7, 2)::INT AS number, CASE WHEN p_size = 30 THEN '{"sample":null}' ELSE '{"sample":{' ||
    CASE WHEN p_type = 'PROMO' AND p_size < 8 THEN '"more":1,' ELSE '' END || '"utt":"' || CASE WHEN starts_with(p_name, 'hot') AND p_size < 12 THEN '  ' ELSE '請找' || p_name || '的商品資料還有更多相關的說明給我看看' END ||
    '","intent":' || CASE WHEN p_size > 46 THEN '"resize"' WHEN p_size = 7 THEN '5' ELSE '"find"' END || ',"slots":[{"type":"' || CASE WHEN substr(p_brand, 7, 2)::INT = 3 THEN 'colour' ELSE 'name' END ||
    '","value":' || CASE WHEN p_size = 9 THEN p_size::VARCHAR ELSE '"' || p_name || '"' END || '}],"id":"syn_' || left(sha256(p_partkey::VARCHAR), CASE WHEN p_size = 20 THEN 19 ELSE 20 END) || '","style":"massive_like","provenance":{"recipe":"noise_codeswitch",' ||
    CASE WHEN p_type = 'LARGE' AND p_size < 6 THEN '' ELSE '"model":"m",' END || '"gen_params":{"temperature":' || (substr(p_brand, 7, 2)::INT / 10)::DOUBLE || '}}}}' END || CASE WHEN p_size = 31 THEN ' and more' ELSE '' END AS raw
  FROM part
), j AS (
  SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN json_extract(raw, '$.sample') END AS s FROM x
), e AS (
  SELECT *, ok AND json_type(s) = 'OBJECT' AS there, list_filter([
    CASE WHEN trim(s->>'$.utt') = '' THEN 'utt' END,
    CASE WHEN json_type(s, '$.intent') <> 'VARCHAR' OR s->>'$.intent' NOT IN ('find', 'order') THEN 'intent' END,
    CASE WHEN s->>'$.slots[0].type' NOT IN ('thing', 'name', 'size') THEN 'slots.0.type' END,
    CASE WHEN json_type(s, '$.slots[0].value') <> 'VARCHAR' THEN 'slots.0.value' END,
    CASE WHEN NOT regexp_full_match(s->>'$.id', 'syn_[0-9a-f]{20}') THEN 'id' END,
    CASE WHEN NOT json_exists(s, '$.provenance.model') THEN 'provenance.model' END,
    CASE WHEN (s->>'$.provenance.gen_params.temperature')::DOUBLE > 2 THEN 'provenance.gen_params.temperature' END,
    CASE WHEN list_contains(json_keys(s), 'more') THEN 'more' END], lambda p: p IS NOT NULL) AS found,
    json_type(s, '$.intent') = 'VARCHAR' AND s->>'$.intent' NOT IN ('find', 'order') AS odd_intent, s->>'$.slots[0].type' NOT IN ('thing', 'name', 'size') AS odd_kind
  FROM j
), r AS (
  SELECT p_partkey, there, CASE WHEN there THEN array_to_string(list_sort(found), ',') WHEN ok THEN 'sample' ELSE '' END AS paths, p_name,
    CASE WHEN NOT coalesce(there, false) THEN 'F1_SCHEMA_MISSING_SAMPLE' WHEN len(found) = 0 THEN NULL
      WHEN len(found) > odd_intent::INT + odd_kind::INT THEN 'F1_SCHEMA_INVALID' WHEN odd_intent THEN 'F2_LABEL_UNKNOWN_INTENT' ELSE 'F2_LABEL_UNKNOWN_SLOT' END AS reason,
    length(regexp_replace(p_name, '[^a-z]', '', 'g')) / (length(regexp_replace(p_name, '[^a-z]', '', 'g')) + 20) AS latin
  FROM e
)
SELECT p_partkey, paths, CASE WHEN reason IS NOT NULL THEN reason WHEN latin > 0.55 THEN 'F4_LOCALE_LANGUAGE_RATIO' ELSE 'accepted' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN 'none' WHEN latin > 0.55 THEN 'F3' ELSE 'F4' END AS passed_stage
FROM r
"""


# --- Files ----------------------------------------------------------------------------------------


def _bucket(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(16)).cast("int")


def _written_lines(spark: SparkSession, d: str) -> str:
    """Documents as JSON lines, a file a bucket in order of doc_id: blank lines for short ones, no sample for Spanish ones, no text and no JSON for some."""
    docs = table(spark, d, "documents")
    sample = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("n_chars") % 11 == 0, " \t").otherwise(F.col("text")).alias("utt"))
    whole = F.to_json(F.struct(F.when(F.col("lang") != "es", sample).alias("sample")), {"ignoreNullFields": "false"})
    line = F.when(F.col("n_chars") < 200, "").when(F.col("n_chars") % 13 == 0, F.concat(F.lit("x"), whole)).otherwise(whole)
    out = scratch(spark, "lines")
    rows = docs.select(_bucket("doc_id").alias("bucket"), "doc_id", line.alias("value")).repartition(16, "bucket").sortWithinPartitions("bucket", "doc_id")
    rows.select("bucket", "value").write.partitionBy("bucket").text(out)
    return out


def _of_path(column: str) -> Column:
    return F.regexp_extract(column, r"bucket=([0-9]+)", 1).cast("int").alias("bucket")


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line that isn't blank, with its number in its file and what is wrong with it."""
    rows = tables.samples(spark, _written_lines(spark, d))
    return rows.select(_of_path("file"), "line", "id", F.coalesce("problem", F.lit("none")).alias("problem"))


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of each written file."""
    found = manifests.files(spark, _written_lines(spark, d), "part-*")
    return found.select(_of_path("path"), "bytes", "digest")


_LINES = r"""
WITH l AS (
  SELECT doc_id % 16 AS bucket, doc_id, n_chars, lang, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line FROM documents
)
"""
_LINE_TEXT = """
WITH l AS (
  SELECT doc_id % 16 AS bucket, doc_id, CASE WHEN n_chars < 200 THEN '' ELSE CASE WHEN n_chars % 13 = 0 THEN 'x' ELSE '' END ||
    CASE WHEN lang = 'es' THEN '{"sample":null}' ELSE '{"sample":{"id":"' || doc_id || '","utt":' || CASE WHEN n_chars % 11 = 0 THEN '" \\t"' ELSE to_json(text)::VARCHAR END || '}}' END END AS value
  FROM documents
)
"""


def release_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a release of languages with the sizes they must have, and read back: rows and characters by language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    out = scratch(spark, "release")
    written = writers.release(docs, "doc_id", "lang", sizes, out)
    back = tables.json_lines(spark, out, "doc_id BIGINT, lang STRING, text STRING")
    counts = back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if("bad").alias("bad"))
    return counts.crossJoin(written.agg((F.sum("bytes") > 0).alias("has_bytes")))


# --- Manifests ------------------------------------------------------------------------------------


def split_manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Samples of 20 documents a language, frozen before short documents go and made again after: the languages whose sample isn't the same, with how."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    frozen = rebuilds.sample_manifest(sampling.per_stratum(docs, "lang", "doc_id", 20), "lang", "doc_id")
    again = rebuilds.sample_manifest(sampling.per_stratum(docs.where("n_chars >= 60 AND lang <> 'es'"), "lang", "doc_id", 20), "lang", "doc_id")
    return rebuilds.manifest_changes(again, frozen, "lang")


def report_differences(spark: SparkSession, d: str) -> DataFrame:
    """Means by language, computed from the documents and held against published ones of three decimals: the paths of numbers that rounding moved too far."""
    docs = table(spark, d, "documents")
    found = docs.groupBy("lang", "source").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    told = found.where("n > 1").select("lang", "source", F.round("mean", 1).alias("mean"), "n")
    names = ["lang", "source"], ["mean", "n"]
    out = rebuilds.compared(rebuilds.named(found, "docs", *names), rebuilds.named(told, "docs", *names), relative=0.0, absolute=0.03)
    return out.select("path", F.round("found", 6).alias("found"), F.round("told", 6).alias("told"), "problem")


QUERIES = {f.__name__: f for f in (grounded_in_both_scripts, raw_record_errors, numbered_lines, file_digests, release_rows, split_manifest_changes, report_differences)}

SQL = {
    "grounded_in_both_scripts": _SAID + """
, g AS (
  SELECT *, thing <> '' AND contains(form, thing) AS holds, CASE WHEN length(thing) >= length(name) THEN thing ELSE name END AS first, CASE WHEN length(thing) >= length(name) THEN name ELSE thing END AS second FROM f
), h AS (
  SELECT *, strpos(form, first) AS place FROM g
)
SELECT p_partkey, form, holds, thing <> '' AND place > 0 AND strpos(substr(form, 1, place - 1) || repeat('#', length(first)) || substr(form, place + length(first)), second) > 0 AS placed,
  CASE WHEN holds AND contains(form, told::VARCHAR) THEN 'kept' ELSE 'F3_UNGROUNDED_SLOT' END AS reason,
  length(regexp_replace(asked, '[^电视机国语闻]', '', 'g')) AS simplified
FROM h
""",
    "raw_record_errors": _RAW_ERRORS,
    "numbered_lines": _LINES + """
SELECT bucket::INT AS bucket, line, CASE WHEN n_chars % 13 <> 0 AND lang <> 'es' THEN doc_id::VARCHAR END AS id,
  CASE WHEN n_chars % 13 = 0 THEN 'not JSON' WHEN lang = 'es' THEN 'missing sample object' WHEN n_chars % 11 = 0 THEN 'missing utterance' ELSE 'none' END AS problem
FROM l WHERE n_chars >= 200
""",
    "file_digests": _LINE_TEXT + """
SELECT bucket::INT AS bucket, sum(octet_length(encode(value)) + 1)::BIGINT AS bytes, sha256(string_agg(value || chr(10), '' ORDER BY doc_id)) AS digest FROM l GROUP BY bucket
""",
    "release_rows": "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, 0::BIGINT AS bad, true AS has_bytes FROM documents GROUP BY lang",
    "split_manifest_changes": """
WITH a AS (SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) <= 20),
b AS (SELECT lang, doc_id FROM documents WHERE n_chars >= 60 AND lang <> 'es' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) <= 20),
c AS (SELECT lang, count(*) AS n, count(*) FILTER ((lang, doc_id) IN (SELECT (lang, doc_id) FROM b)) AS same FROM a GROUP BY lang),
e AS (SELECT lang, count(*) AS n FROM b GROUP BY lang)
SELECT coalesce(c.lang, e.lang) AS lang, CASE WHEN c.n IS NULL THEN 'new' WHEN e.n IS NULL THEN 'gone' WHEN c.n <> e.n THEN 'other size' ELSE 'other rows' END AS problem
FROM c FULL JOIN e ON c.lang = e.lang WHERE c.n IS NULL OR e.n IS NULL OR c.n <> e.n OR same < c.n
""",
    "report_differences": """
WITH f AS (SELECT lang, source, avg(n_chars) AS mean, count(*)::DOUBLE AS n FROM documents GROUP BY ALL),
x AS (
  SELECT 'docs.' || lang || '.' || source || '.mean' AS path, mean AS found, CASE WHEN n > 1 THEN round(mean, 1) END AS told FROM f
  UNION ALL SELECT 'docs.' || lang || '.' || source || '.n', n, CASE WHEN n > 1 THEN n END FROM f
)
SELECT path, round(found, 6) AS found, round(told, 6) AS told, CASE WHEN told IS NULL THEN 'not told' ELSE 'differs' END AS problem FROM x WHERE told IS NULL OR abs(found - told) > 0.03
""",
}
