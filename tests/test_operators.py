"""Small cases of the record, vector, scoring and statistics operators."""

import itertools
import json
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import intervals, text
from lexloom.operators import augmentation, bootstrap, checks, funnel, planning, sampling, scoring, similarity
from lexloom.sources import schemas, tables, writers
from lexloom.sources.tables import kept
from lexloom.streaming import funnel as streaming

SLOTS = "array<struct<type:string,value:string>>"
RECORD = f"id long, sample struct<utt:string,intent:string,slots:{SLOTS},recipe:string>, expected struct<intent:string,slots:{SLOTS}>"


def one(df):
    return df.collect()[0]


def record(utt="明天早上七點叫醒我", intent="alarm_set", slots=(("time", "早上七點"),), recipe="paraphrase", expected=None):
    pairs = [{"type": a, "value": b} for a, b in slots]
    return {"utt": utt, "intent": intent, "slots": pairs, "recipe": recipe}, expected


@pytest.mark.parametrize(
    "case, reason, stage",
    [
        (record(), None, "F4"),
        ((None, None), "F1_SCHEMA_MISSING_SAMPLE", None),
        (record(utt=" "), "F1_SCHEMA_INVALID", None),
        (record(intent="nope"), "F2_LABEL_UNKNOWN_INTENT", "F1"),
        (record(slots=(("nope", "早上七點"),)), "F2_LABEL_UNKNOWN_SLOT", "F1"),
        (record(expected={"intent": "alarm_set", "slots": [{"type": "time", "value": "晚上九點"}]}), "F2_LABEL_CONTRACT_SLOTS", "F2"),
        (record(expected={"intent": "other", "slots": []}), "F2_LABEL_CONTRACT_INTENT", "F2"),
        (record(slots=(("time", "晚上"),)), "F3_UNGROUNDED_OR_OVERLAPPING_SLOT", "F2"),
        (record(utt="去台北", slots=(("place", "台北"), ("place", "北"))), "F3_UNGROUNDED_OR_OVERLAPPING_SLOT", "F2"),
        (record(utt="請在播放清單裡加入ＷＸＹ的歌給我聽", slots=(("place", "wxy"),)), None, "F4"),
        (record(utt="把車燈關掉吧", slots=(("place", "车灯"),)), None, "F4"),
        (record(utt="請開電視機看新聞", slots=(("place", "电视机"),)), None, "F4"),
        (record(utt="我要看國語新聞和國語電影", slots=(("place", "国语"), ("place", "国语新闻"))), None, "F4"),
        (record(utt="我要看國語新聞", slots=(("place", "国语"), ("place", "国语新闻"))), "F3_UNGROUNDED_OR_OVERLAPPING_SLOT", "F2"),
        (record(utt="设早上七點"), "F4_LOCALE_SIMPLIFIED", "F3"),
        (record(utt="早上七點打開視頻"), "F4_LOCALE_MAINLAND_TERM", "F3"),
        (record(utt="早上七點かな"), "F4_LOCALE_UNEXPECTED_SCRIPT", "F3"),
        (record(utt="早上七點 wake me up please"), "F4_LOCALE_LANGUAGE_RATIO", "F3"),
        (record(utt="早上七點set一個鬧鐘alarm", recipe="noise_codeswitch"), None, "F4"),
    ],
)
def test_funnel_gives_first_reason(spark, case, reason, stage):
    df = spark.createDataFrame([(1, *case)], RECORD)
    row = one(funnel.validated(df, ["alarm_set", "other"], ["time", "place"]))
    assert (row.reject_reason, row.passed_stage) == (reason, stage)


def test_funnel_counts_add_up(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate([record(), (None, None), record(intent="nope")])], RECORD)
    row = one(funnel.counts(funnel.validated(df, ["alarm_set"], ["time"])))
    assert row.total == row.accepted + row.rejected == 3 and row.passed_f1 == 2


def test_funnel_on_a_stream_appends_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, *record()), (1, *record()), (2, None, None)], RECORD)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streaming.run(spark, str(tmp_path / "in"), RECORD, ["alarm_set"], ["time"], "id", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_annotated_text(spark):
    df = spark.createDataFrame([("order [dish : fried rice] for [count: 3 ] people",), ("a [b",)], "t string")
    good, bad = (r.a for r in df.select(text.annotated(F.col("t")).alias("a")).collect())
    assert good.utterance == "order fried rice for 3 people" and [tuple(s) for s in good.slots] == [("dish", "fried rice"), ("count", "3")] and good.error is None
    assert bad.error == "unread bracket"


def test_exact_comparison_form_folds_widths_and_case(spark):
    df = spark.createDataFrame([("ＸＹ　ｚ９",), ("Maße 软",), (None,)], "t string")
    assert [r.f for r in df.select(text.comparison_form(F.col("t"), exact=True).alias("f")).collect()] == ["xyz9", "masse軟", None]


def test_strict_parse_outcomes(spark):
    good = '{"intent": "a", "slots": [{"type": "k", "value": " v "}]}'
    raw = [good, f"  {good}\n", f"```{good}```", "not json", good.replace('"a"', '"z"'), good.replace('"k"', '"z"'), good.replace('"slots"', '"x": 1, "slots"'), "[1]", '{"intent": 5, "slots": []}', None, "[" * 200_000]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select(scoring.strict_parse(["a"], ["k"])("raw").alias("p"))
    assert [r.p.outcome for r in df.collect()] == ["valid", "valid", "json_decode_error", "json_decode_error", "unknown_intent", "unknown_slot_type", "schema_validation_error", "schema_validation_error", "schema_validation_error", "json_decode_error", "json_decode_error"]
    assert df.first().p.slots[0].value == "v"


def test_macro_f1_counts_labels_without_rows(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", None)], "expected string, predicted string")
    labels = spark.createDataFrame([(x,) for x in "abcdefghij"], "label string")
    assert one(scoring.macro_f1(rows, labels)).macro_f1 == pytest.approx(0.1)
    assert one(scoring.accuracy(rows)).accuracy == 0.5


def test_slot_counts_are_multisets(spark):
    e = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "i int, w string")
    p = spark.createDataFrame([(1, "x"), (1, "z"), (1, "z")], "i int, w string")
    r = one(scoring.slot_counts(e, p, "i"))
    assert (r.tp, r.fp, r.fn) == (1, 2, 2)


def test_wilson_holm_mcnemar(spark):
    low, high = intervals.wilson(F.lit(437), F.lit(500))
    bad, _ = intervals.wilson(F.lit(5), F.lit(0))
    r = one(spark.range(1).select(low.alias("low"), high.alias("high"), bad.alias("bad"), intervals.mcnemar_p(F.lit(1), F.lit(2)).alias("p"), intervals.mcnemar_p(F.lit(700), F.lit(900)).alias("q")))
    assert r.low == pytest.approx(0.842, abs=1e-3) and r.bad is None and r.p == 1.0 and 0 < r.q < 1e-6
    p = spark.createDataFrame([(0.03,), (0.001,), (0.02,)], "p double").select("p", intervals.holm(F.col("p")).alias("h"))
    assert [x.h for x in sorted(p.collect())] == pytest.approx([0.003, 0.04, 0.04])


def test_audit_strata(spark):
    rows = spark.createDataFrame([(i, i < 8, float(i % 50), i == 9) for i in range(100)], "id long, hard boolean, margin double, changed boolean")
    got = sampling.audit(rows, "id", F.col("hard"), F.col("changed"), F.col("margin"), 0.10)
    assert {r.stratum: r.n for r in got.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {"hard_negative": 8, "boundary_conflict": 1, "random": 1}
    assert got.where("stratum = 'boundary_conflict'").first().id == 9
    assert got.select("id").distinct().count() == 10


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumn("s", F.col("id") % 3)
    want = sorted(map(tuple, sampling.per_stratum(rows, "s", "id", 5).collect()))
    assert sorted(map(tuple, sampling.per_stratum(rows.repartition(7), "s", "id", 5).collect())) == want and len(want) == 15
    with pytest.raises(Exception, match="fewer than"):
        sampling.exactly(rows, "id", 501).collect()


def vectors(spark, rows):
    df = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in rows], "id long, ord long, v array<double>")
    return df.select("id", "ord", similarity.unit(F.col("v")).alias("vec"))


def test_nearest(spark):
    v = vectors(spark, [(0, (1, 0)), (1, (0.8, 0.6)), (2, (0, 1))])
    assert [round(r.similarity, 6) for r in similarity.nearest(v, v, exclude_self=True).orderBy("id").collect()] == [0.8, 0.8, 0.6]
    with pytest.raises(ValueError, match="another one"):
        similarity.nearest_other(v.where("id = 1"))
    none = similarity.nearest(v, v.where("false"))
    assert {r.similarity for r in none.collect()} == {-1.0}
    with pytest.raises(Exception, match="no length"):
        vectors(spark, [(0, (0, 0))]).collect()


def greedy(c, s, e, t):
    taken, out = [], {}
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 9)
    for i, v in sorted(c):
        prior, seed, ev = (max((dot(v, w) for w in ws), default=-1.0) for ws in (taken, [w for _, w in s], [w for _, w in e]))
        out[i] = "F5_DUP_SYNTHETIC" if prior >= t.duplicate else "F5_DUP_SEED" if seed >= t.too_close else "F5_OUTLIER_SEED" if seed <= t.outlier else "F6_CONTAM_EVAL" if ev >= t.contamination else None
        if out[i] is None:
            taken.append(v)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_links_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(90)]
    unit = {i: [x / math.hypot(*v) for x in v] for i, v in rows}
    want = {(i, j) for i, a in unit.items() for j, b in unit.items() if i < j and round(sum(x * y for x, y in zip(a, b)), 9) >= 0.9}
    got = [(r.early, r.late) for r in similarity.links(vectors(spark, rows), 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert similarity.links(vectors(spark, rows).limit(0), 0.9).count() == 0


def test_far_blocks_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 10)
    rows = [(i, (1 if i % 2 else -1, 0.001 * i)) for i in range(80)]
    met = []
    monkeypatch.setattr(similarity, "_pruned", lambda dealt, stats, pivots, threshold, f=similarity._pruned: met.append(stats) or f(dealt, stats, pivots, threshold))
    assert similarity.links(vectors(spark, rows), 0.99).count() == 2 * (40 * 39 // 2)
    assert len(met[0]) > 1 and max(radius for _, radius in met[0].values()) < 0.1


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_repeated_vectors_are_decided_as_rows_are(spark, broadcast, monkeypatch):
    monkeypatch.setattr(similarity, "FEW_BYTES", broadcast)
    rng = random.Random(6)
    some = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(12)]
    c = [(i, rng.choice(some)) for i in range(70)]
    s, e = [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(5)], [(200 + i, some[i]) for i in range(2)]
    limits = similarity.Thresholds(0.9, 0.97, 0.1, 0.98)
    got = similarity.decisions(vectors(spark, c), vectors(spark, s), vectors(spark, e), limits, lambda df, name: kept(df)).collect()
    assert {r.id: r.reject_reason for r in got} == greedy(c, s, e, limits)
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 9)
    taken = [(i, v) for i, v in c if {r.id: r.passed for r in got}[i]]
    for r in got:
        assert r.max_prior == pytest.approx(max((dot(dict(c)[r.id], v) for i, v in taken if i < r.id), default=-1.0), abs=2e-9)


def test_decisions_are_those_of_a_pass_in_order(spark):
    rng = random.Random(4)
    draw = lambda a, n: [(a + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    c, s, e = draw(0, 60), draw(100, 5), draw(200, 5)
    limits = similarity.Thresholds(0.9, 0.97, 0.1, 0.98)
    keep = lambda df, name: df.checkpoint()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = similarity.decisions(vectors(spark, c), vectors(spark, s), vectors(spark, e), limits, keep)
    assert {r.id: r.reject_reason for r in got.collect()} == greedy(c, s, e, limits)
    with pytest.raises(ValueError):
        similarity.Thresholds(0.9, 0.1, 0.5, 0.9)


def test_allocation_sums_and_breaks_ties_by_name(spark):
    found = lambda n, shares=None: {r.recipe: r.n for r in planning.allocation(spark, n, shares).collect()}
    assert found(1) == {"paraphrase": 1, "slot_substitution": 0, "noise_codeswitch": 0, "hard_negative": 0}
    assert all(sum(found(n).values()) == n for n in (2, 3, 7, 19, 58))
    assert found(1, {"a": 0.5, "b": 0.5}) == {"a": 0, "b": 1}


def test_augmented_examples_keep_slots(spark):
    rows = [(0, "s0", "請打開客廳的燈", "on", [("place", "客廳")]), (1, "s1", "今天在台北要帶傘嗎", "weather", [("place", "台北")])]
    seeds = spark.createDataFrame(rows, f"pos long, id string, utt string, intent string, slots {SLOTS}")
    a = [tuple(r) for r in augmentation.augmented(seeds, 12, attempts=400).collect()]
    assert len({r[0] for r in a}) == 12 and sorted(a) == sorted(tuple(r) for r in augmentation.augmented(seeds.repartition(3), 12, attempts=400).collect())
    assert all(s.value in r[1] for r in a for s in r[3])
    with pytest.raises(Exception, match="fewer than 5000"):
        augmentation.augmented(seeds, 5000).collect()
    made = augmentation.probes(seeds).collect()
    assert len(made) == 6 and all(len({r.utt for r in g}) == 3 for _, g in itertools.groupby(sorted(made, key=lambda r: r.source_test_id), lambda r: r.source_test_id))


def test_probes_are_the_first_of_each_kind_and_all_different(spark):
    rows = [(k, f"s{k}", u, "i", [("t", v)]) for k, (u, v) in enumerate([("請打開客廳的燈", "客廳"), ("今天在台北要帶傘嗎", "台北"), ("設定設定", "設定"), ("abc", "c"), ("在在在", "nothing"), ("請請", "請")])]
    seeds = spark.createDataFrame(rows, f"pos long, id string, utt string, intent string, slots {SLOTS}")
    fronts = [("probe", "front", "", f"{w}，", 0) for w in augmentation.FILLERS]
    order = augmentation._order(42).alias("order")
    found = [(r.id, r._kind, r.order, r.made) for r in augmentation.candidates(seeds, 42).select("id", "_kind", order, "made").collect()]
    filled = augmentation.candidates(seeds, 42, fronts).withColumn("_kind", F.lit("filler"))
    found += [(r.id, "filler", r.order, r.made) for r in filled.select("id", order, "made").collect()]
    want, first = {}, {}
    kinds = [(name, k, of) for name, ofs in augmentation.PROBES.items() for k, of in enumerate(ofs)]
    for i, of, o, made in found:
        for name, k, kind in kinds:
            if kind == of:
                choice = (name, 0 if name == "colloquial" else k, o)
                first[i, made] = min(first.get((i, made), choice), choice)
    for (i, made), (name, k, o) in first.items():
        want[i, name] = min(want.get((i, name), (k, o, made)), (k, o, made))
    got = {(r.source_test_id, r.probe_kind): r.utt for r in augmentation.probes(seeds).collect()}
    assert got == {key: made for key, (_, _, made) in want.items()} and "s4" not in {i for i, _ in got}
    with pytest.raises(Exception, match="no probe of some kind for s3"):
        augmentation.probes(seeds.where("id = 's3'"), strict=True).collect()


def test_nearest_by_width_is_nearest_of_each_width(spark):
    rng = random.Random(9)
    a, b = ([(k + at, [rng.gauss(0, 1) for _ in range(6)]) for k in range(n)] for at, n in ((0, 30), (100, 8)))
    got = {(r.width, r.id): (r.nearest_id, round(r.similarity, 6)) for r in similarity.nearest_by_width(vectors(spark, a), vectors(spark, b), (3, 6)).collect()}
    for width in (3, 6):
        found = similarity.nearest(*(vectors(spark, [(i, v[:width]) for i, v in x]) for x in (a, b)))
        assert {(width, r.id): (r.nearest_id, round(r.similarity, 6)) for r in found.collect()} == {k: v for k, v in got.items() if k[0] == width}


def test_nearest_in_many_blocks_shuffles_no_pairs(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("TILE", 20), ("SHARES", 2), ("SHARE_BLOCKS", 3)):
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(11)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(20)]
    rows = [(i, rng.choice(some) if i % 3 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    dot = lambda i, j: round(float(unit[i] @ unit[j]), 9)
    found = similarity.nearest_other(vectors(spark, rows))
    assert {r.id: r.nearest_id for r in found.collect()} == {i: min((-dot(i, j), j) for j in unit if j != i)[1] for i in unit}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # blocks are read where they are kept, not repeated for each pair


def test_similarities_are_held_by_tiles(spark):
    a, b = np.ones((3000, 2)), np.ones((2000, 2))
    tracemalloc.start()
    assert sum(s.sum() for _, s in similarity._tiles(a, b)) == 2 * 3000 * 2000
    assert tracemalloc.get_traced_memory()[1] < 3 * 8 * similarity.TILE  # all at once take 48 MB
    tracemalloc.stop()


def test_bootstrap_draws_from_any_number_of_rows(spark):
    rows = spark.range(2_400_000).selectExpr("id % 2 AS seed", "cast(id % 8 < 4 AS int) AS base_hit", "cast(id % 8 < 6 AS int) AS new_hit")
    out = bootstrap.interval(bootstrap.deltas(rows, 100)).first()
    assert abs(out.mean_delta - 0.25) < 0.001 and 0.247 < out.low < out.high < 0.253


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    rows = spark.createDataFrame([(s, i % 2, int(i % 3 > 0)) for s in range(3) for i in range(30)], "seed int, base_hit int, new_hit int")
    a = one(bootstrap.interval(bootstrap.deltas(rows, 200)))
    b = one(bootstrap.interval(bootstrap.deltas(rows.repartition(5), 200)))
    assert a == b and a.low < a.mean_delta < a.high and a.mean_delta == pytest.approx(1 / 6, abs=0.05)


def test_checks(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (4,)], "i long")
    assert one(checks.contiguous(df, "i")).contiguous is False and one(checks.contiguous(spark.range(4), "id")).contiguous
    assert one(checks.repeated(df, "i")).n == 2
    with pytest.raises(Exception, match="bad rows"):
        checks.must_be_empty(df, "bad rows").collect()


def test_json_lines_keep_bad_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\nnope\n')
    got = tables.json_lines(spark, str(tmp_path / "x.jsonl"), "a INT, b STRUCT<c: STRING>").orderBy("a").collect()
    assert [(r.a, r.bad, r.raw) for r in got] == [(None, True, "nope"), (1, False, '{"a": 1, "b": {"c": "x"}}')]
    assert spark.createDataFrame([], schemas.RECORD).columns[0] == "schema_version"
    df = spark.createDataFrame([(1, None, 1), (1, "z", 2)], "k int, v string, o int")
    writers.json_lines(writers.compacted(df, "k", "o"), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"k": 1, "v": "z", "o": 2}]
