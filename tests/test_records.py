"""The comparison form against Python's own, and raw records: every error with its path."""

import copy
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import funnel, records
from lexloom.plans.records import raw_record_errors

INTENTS, KINDS = ["alarm_set", "play"], ["time", "place"]


def by_hand(value):
    table = str.maketrans(text.simplified())
    return "".join(unicodedata.normalize("NFKC", value).translate(table).split()).casefold()


def test_comparison_form_is_that_of_python(spark):
    rng = random.Random(1)
    letters = "aZß éÉİıſＡｂ１　   \x1c\x85\n设鬧闹國国語语ﬁ①㎏ΣςΆ한가\U0001f600'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(500)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.comparison_form(F.col("t"), exact=True).alias("form"))
    assert all(r.form == (None if r.t is None else by_hand(r.t)) for r in df.collect())


def test_table_has_thousands_of_pairs_and_none_for_traditional_forms(spark):
    table = text.simplified()
    assert len(table) > 2500 and all(len(k) == len(v) == 1 for k, v in table.items())
    assert "".join(map(table.get, "电视机国语闻设闹钟")) == "電視機國語聞設鬧鐘" and not set("電視機國語聞設鬧鐘明天早上") & set(table)


@pytest.mark.parametrize("hay, needle, want", [("幫我設 ＡＭ ８：３０ 的鬧鐘", "AM 8:30", True), ("任意句子", "   ", False), ("我要看國語新聞", "国语新闻", True), ("ＡＢＣ好", "ABC", True), ("Straße", "STRASSE", True), ("abc", None, None)])
def test_holds(spark, hay, needle, want):
    df = spark.createDataFrame([(hay, needle)], "a string, b string")
    assert df.select(text.holds(F.col("a"), F.col("b")).alias("x")).first().x is want


@pytest.mark.parametrize("slots, want", [([("time", "ABC")], None), ([("time", "abd")], "F3_UNGROUNDED_SLOT"), ([("place", "ABC")], "F2_SLOT_CONTRACT")])
def test_contract_of_a_request_uses_the_exact_form(spark, slots, want):
    kind = "struct<utt:string,intent:string,slots:array<struct<type:string,value:string>>>"
    expected = [("time", v) for _, v in slots]
    df = spark.createDataFrame([(("ＡＢＣ好", "play", slots), (None, "play", expected))], f"sample {kind}, expected {kind}")
    assert df.select(funnel.generation_reason(F.col("sample"), F.col("expected")).alias("r")).first().r == want


def good():
    return {
        "id": "syn_0123456789abcdefabcd",
        "utt": " 明天早上七點叫醒我 ",
        "intent": "alarm_set",
        "slots": [{"type": "time", "value": "早上七點"}],
        "style": "massive_like",
        "provenance": {
            "recipe": "paraphrase",
            "model": "m",
            "model_digest": "d",
            "prompt_version": "paraphrase.v1",
            "seed_sample_id": "seed",
            "gen_params": {"temperature": 0.2, "top_p": 1, "seed": 42, "context_length": "4096"},
            "filter_score": {"a": 1.5},
            "filter_stage_passed": None,
            "reject_reason": None,
            "generated_at": "2026-01-02T03:04:05+00:00",
            "pair_id": None,
        },
    }


def changed(*changes, expected=None):
    """A good record with (path, value) set, or taken out where the value is ...; extra keys come the same way."""
    sample = copy.deepcopy(good())
    for path, value in changes:
        *way, last = path.split(".")
        at = sample
        for step in way:
            at = at[int(step) if step.isdigit() else step]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps({"sample": sample, "expected": expected})


PAIR = [("provenance.recipe", "hard_negative"), ("provenance.seed_sample_id", ["a", "b"]), ("provenance.pair_id", "p")]
CASES = [
    (changed(), [], None, "F4"),
    (changed(*PAIR), [], None, "F4"),
    ("not json", [""], "F1_SCHEMA_MISSING_SAMPLE", None),
    (changed() + " x", [""], "F1_SCHEMA_MISSING_SAMPLE", None),
    (changed() + "],[" + changed(), [""], "F1_SCHEMA_MISSING_SAMPLE", None),
    (None, [""], "F1_SCHEMA_MISSING_SAMPLE", None),
    ("[1]", ["sample"], "F1_SCHEMA_MISSING_SAMPLE", None),
    ('{"sample": [1]}', ["sample"], "F1_SCHEMA_MISSING_SAMPLE", None),
    ('{"sample": {}}', ["utt", "intent", "slots", "id", "style", "provenance"], "F1_SCHEMA_INVALID", None),
    (changed(("intent", "nope")), ["intent"], "F2_LABEL_UNKNOWN_INTENT", None),
    (changed(("slots.0.type", "nope")), ["slots.0.type"], "F2_LABEL_UNKNOWN_SLOT", None),
    (changed(("slots.0.type", "nope"), ("intent", "nope")), ["intent", "slots.0.type"], "F2_LABEL_UNKNOWN_INTENT", None),
    (changed(("slots.0.type", "nope"), ("more", 1)), ["slots.0.type", "more"], "F1_SCHEMA_INVALID", None),
    (changed(("intent", "nope"), ("utt", "  ")), ["utt", "intent"], "F1_SCHEMA_INVALID", None),
    (changed(("intent", 5)), ["intent"], "F1_SCHEMA_INVALID", None),
    (changed(("intent", "")), ["intent"], "F1_SCHEMA_INVALID", None),
    (changed(("slots.0.more", 1)), ["slots.0.more"], "F1_SCHEMA_INVALID", None),
    (changed(("slots", ["x", {"type": "time"}])), ["slots.0", "slots.1.value"], "F1_SCHEMA_INVALID", None),
    (changed(("slots", {"type": "time"})), ["slots"], "F1_SCHEMA_INVALID", None),
    (changed(("id", "syn_0")), ["id"], "F1_SCHEMA_INVALID", None),
    (changed(("style", "other"), ("provenance.recipe", "other")), ["style", "provenance.recipe"], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.gen_params.temperature", 2.5)), ["provenance.gen_params.temperature"], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.gen_params.top_p", 0), ("provenance.gen_params.seed", 1.5), ("provenance.gen_params.context_length", "x")), [f"provenance.gen_params.{n}" for n in ("top_p", "seed", "context_length")], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.gen_params.top_p", True), ("provenance.gen_params.seed", "7")), [], None, "F4"),
    (changed(("provenance.filter_score", {"a": "x", "b": 2})), ["provenance.filter_score.a"], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.reject_reason", ...)), ["provenance.reject_reason"], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.pair_id", ...)), [], None, "F4"),
    (changed(("provenance.generated_at", "yesterday")), ["provenance.generated_at"], "F1_SCHEMA_INVALID", None),
    (changed(("provenance.seed_sample_id", ["a", 1])), ["provenance.seed_sample_id.1"], "F1_SCHEMA_INVALID", None),
    (changed(*PAIR, ("provenance.seed_sample_id", "a")), ["provenance"], "F1_SCHEMA_INVALID", None),
    (changed(*PAIR, ("provenance.pair_id", "")), ["provenance"], "F1_SCHEMA_INVALID", None),
    (changed(expected=[1]), [], "F1_SCHEMA_INVALID_EXPECTED", "F2"),
    (changed(expected={"intent": "play", "slots": 1}), [], "F2_LABEL_CONTRACT_INTENT", "F2"),
    (changed(expected={"intent": "alarm_set", "slots": 1}), [], "F1_SCHEMA_INVALID_EXPECTED", "F2"),
    (changed(expected={"intent": "alarm_set", "slots": [1]}), [], "F2_LABEL_CONTRACT_SLOTS", "F2"),
    (changed(expected={"intent": "alarm_set", "slots": [{"type": "time", "value": "早上七點"}]}), [], None, "F4"),
    (changed(("slots.0.value", "晚上")), [], "F3_UNGROUNDED_OR_OVERLAPPING_SLOT", "F2"),
    (changed(("utt", "设早上七點")), [], "F4_LOCALE_SIMPLIFIED", "F3"),
]


def test_all_errors_of_raw_records(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, *_) in enumerate(CASES)], "k int, raw string")
    got = funnel.validated(records.read(df, "raw", INTENTS, KINDS), INTENTS, KINDS).orderBy("k").collect()
    assert [([e.path for e in r.errors], r.reject_reason, r.passed_stage) for r in got] == [tuple(c[1:]) for c in CASES]
    assert got[0].sample.utt == "明天早上七點叫醒我" and got[-1].scores == {"slot_span_count": 1.0, "simplified_char_count": 1.0}


def test_streamed_records_meet_the_same_rules(spark, tmp_path):
    spark.createDataFrame([(raw,) for raw, *_ in CASES if raw and "\n" not in raw], "value string").write.text(str(tmp_path / "in"))
    stream = funnel.validated(records.read(spark.readStream.text(str(tmp_path / "in")), "value", INTENTS, KINDS), INTENTS, KINDS)
    stream.select("reject_reason").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(str(r.reject_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(str(c[2]) for c in CASES if c[0])


def test_records_of_one_split_are_judged_by_many_tasks(spark, tmp_path):
    rows = [(k, f"red {k}", "Brand#12", "SMALL", k % 40) for k in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = raw_record_errors(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 50
