"""Plans of requests, substitutions, paired statistics, and set changes against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bootstrap, planning, reports, requests
from lexloom.plans.reports import finalized_release
from lexloom.sources.tables import kept

POOL = "pos long, id string, utt string, intent string, slots array<struct<type:string,value:string>>"
PAIRS = [("a", "b"), ("b", "c")]


def seeds(n=7):
    rows = []
    for k in range(n):
        value = f"v{k % 3}"
        rows.append((k, f"s{k}", f"say {value} or {value} and w", "abc"[k % 3], [("t", value), ("u", "w")]))
    return rows


# --- Substitutions


def first_by_hand(slots):
    bank = {}
    for row in sorted(slots, key=lambda r: (r[1], r[2])):
        bank.setdefault(row[4], [])
        if row[5] not in bank[row[4]]:
            bank[row[4]].append(row[5])
    out = {}
    for row_id, _, place, text, kind, value in sorted(slots, key=lambda r: (r[1], r[2])):
        if row_id not in out and value in text:
            new = next((v for v in bank[kind] if v != value and v not in text), None)
            if new is not None:
                out[row_id] = (place, kind, value, new)
    return out


@pytest.mark.parametrize("bank", [1, 2, 16])
def test_first_substitutions(spark, bank, monkeypatch):
    monkeypatch.setattr(planning, "BANK", bank)
    rng = random.Random(bank)
    slots = []
    for row in range(60):
        values = [f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))]
        text = " ".join(rng.sample([f"v{k}" for k in range(9)], rng.randrange(0, 9)))
        slots += [(row, row, k, text, rng.choice(["x", "y", "only"]) if v != "v8" else "z", v) for k, v in enumerate(values)]
    df = spark.createDataFrame(slots, "row_id long, row_pos long, slot_pos int, text string, type string, value string").repartition(3)
    assert {r.row_id: tuple(r)[1:] for r in planning.first_substitutions(df).collect()} == first_by_hand(slots)
    assert planning.first_substitutions(df.limit(0)).count() == 0


# --- Requests


def test_plan_has_exactly_so_many_requests(spark):
    pool = spark.createDataFrame(seeds(), POOL)
    rows = requests.plan(spark, 101, pool, PAIRS).orderBy("turn").collect()
    assert [r.turn for r in rows] == list(range(101)) and len({(r.recipe, r.idx) for r in rows}) == 101
    by = {k: [r for r in sorted(rows, key=lambda r: r.idx) if r.recipe == k] for k in requests.TEMPLATES}
    assert {k: len(v) for k, v in by.items()} == {"paraphrase": 36, "slot_substitution": 30, "noise_codeswitch": 20, "hard_negative": 15}
    assert [r.seed_ids for r in by["paraphrase"]] == [[f"s{k % 7}"] for k in range(36)]
    assert [r.seed_ids for r in by["noise_codeswitch"]] == [[f"s{(k + 311) % 7}"] for k in range(20)]
    assert {r.style for r in by["noise_codeswitch"]} == {"tw_colloquial"} and [r.style for r in by["paraphrase"][:2]] == ["massive_like", "tw_colloquial"]
    first = by["slot_substitution"][0]
    assert [tuple(s) for s in first.expected_slots] == [("t", "v1"), ("u", "w")] and '"utt":"say v1 or v0 and w"' in first.prompt
    groups = {i: [s[1] for s in seeds() if s[3] == i] for i in "abc"}
    for k, r in enumerate(by["hard_negative"]):
        a, b = PAIRS[k % 2]
        assert r.seed_ids == [groups[a][k // 2 % len(groups[a])], groups[b][k // 2 % len(groups[b])]] and r.expected_intent == b
        assert r.pair_id.startswith("pair_") and len(r.pair_id) == 21
    assert all("{{" not in r.prompt for r in rows)


def test_plan_is_the_same_on_any_partitioning_and_known_by_its_fingerprints(spark):
    pool = spark.createDataFrame(seeds(), POOL)
    plan = kept(requests.plan(spark, 60, pool, PAIRS))
    again = kept(requests.plan(spark, 60, pool.repartition(5), PAIRS))
    assert reports.drifted(plan, again, "turn", "fingerprint").count() == 0
    other = requests.TEMPLATES | {"paraphrase": requests.TEMPLATES["paraphrase"] + " Be brief."}
    changed = kept(requests.plan(spark, 60, pool, PAIRS, other))
    drift = {r.turn for r in reports.drifted(plan, changed, "turn", "fingerprint").collect()}
    assert drift == {r.turn for r in plan.where("recipe = 'paraphrase'").collect()}
    short = requests.plan(spark, 40, pool, PAIRS).select("turn", "fingerprint")
    assert reports.drifted(plan, short, "turn", "fingerprint").where("problem = 'outside the plan'").count() == 20


def test_plan_refuses_what_it_cannot_make(spark):
    pool = spark.createDataFrame(seeds(), POOL)
    with pytest.raises(Exception, match="a placeholder is left"):
        requests.plan(spark, 20, pool, PAIRS, requests.TEMPLATES | {"paraphrase": "{{SEED}} {{OTHER}}"}).collect()
    with pytest.raises(Exception, match="no seeds of"):
        requests.plan(spark, 20, pool, [("a", "nobody")]).collect()
    with pytest.raises(ValueError, match="two intents"):
        requests.plan(spark, 20, pool, [("a", "a")])
    with pytest.raises(ValueError, match="needs seeds"):
        requests.plan(spark, 20, pool.limit(0), PAIRS)
    alone = spark.createDataFrame([(0, "s", "say v", "a", [("t", "v")])], POOL)
    with pytest.raises(ValueError, match="no value has a substitute"):
        requests.plan(spark, 20, alone, PAIRS)
    with pytest.raises(ValueError, match="a request"):
        requests.plan(spark, 0, pool, PAIRS)


# --- Paired statistics


def answers(rng, n):
    """Rows of two models: (seed, expected, then predicted, valid, exact, tp, fp, fn of either)."""
    out = []
    for k in range(n):
        row = [k % 3, rng.choice("xyz")]
        for skill in (0.5, 0.7):
            predicted = rng.choice([None, "x", "y", "w"]) if rng.random() > skill else row[1]
            tp = rng.randrange(3) if predicted else 0
            row += [predicted, predicted is not None, predicted == row[1] and tp == 2, tp, rng.randrange(2), 2 - tp]
        out.append(tuple(row))
    return out


KIND = "seed int, expected string, " + ", ".join(f"{m}_{c}" for m in ("base", "new") for c in ("predicted string", "valid boolean", "exact boolean", "tp int", "fp int", "fn int"))
LABELS = ["x", "y", "z", "never"]


def scores(rows, model):
    at = 2 + 6 * model
    macro = []
    for label in LABELS:
        tp = sum(r[1] == r[at] == label for r in rows)
        both = sum(r[1] == label for r in rows) + sum(r[at] == label for r in rows)
        macro.append(2 * tp / both if both else 0)
    tp, fp, fn = (sum(r[at + k] for r in rows) for k in (3, 4, 5))
    slots = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0
    return np.array([np.mean([r[1] == r[at] for r in rows]), np.mean(macro), slots, np.mean([r[at + 2] for r in rows]), np.mean([r[at + 1] for r in rows])])


def test_points_are_those_of_rows(spark):
    rows = answers(random.Random(1), 200)
    pairs, labels = spark.createDataFrame(rows, KIND), spark.createDataFrame([(x,) for x in LABELS], "label string")
    got = {(r.seed, r.metric): r.delta for r in bootstrap.point_deltas(pairs, labels).collect()}
    for seed in range(3):
        mine = [r for r in rows if r[0] == seed]
        for metric, value in zip(bootstrap.METRICS, scores(mine, 1) - scores(mine, 0), strict=True):
            assert got[seed, metric] == pytest.approx(value)


def test_drawn_intervals_are_those_of_drawn_rows(spark, monkeypatch):
    rows = answers(random.Random(2), 120)
    pairs, labels = spark.createDataFrame(rows, KIND), spark.createDataFrame([(x,) for x in LABELS], "label string")
    rng, by_seed, want = np.random.default_rng(5), [[r for r in rows if r[0] == s] for s in range(3)], []
    for _ in range(600):
        drawn = [by_seed[k] for k in rng.integers(0, 3, 3)]
        samples = [[mine[k] for k in rng.integers(0, len(mine), len(mine))] for mine in drawn]
        want.append(np.mean([scores(s, 1) - scores(s, 0) for s in samples], axis=0))
    want = np.quantile(want, [0.025, 0.5, 0.975], axis=0)
    for size in (4096, 7):  # one block a seed, and many
        monkeypatch.setattr(bootstrap, "CELLS", size)
        draws = kept(bootstrap.metric_deltas(pairs, labels, 600))
        assert draws.count() == 600 * len(bootstrap.METRICS)
        for k, metric in enumerate(bootstrap.METRICS):
            mine = np.array([r.delta for r in draws.where(F.col("metric") == metric).collect()])
            assert np.quantile(mine, [0.025, 0.5, 0.975]) == pytest.approx(want[:, k], abs=0.035), metric
    again = bootstrap.metric_deltas(pairs.repartition(7), labels, 600)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, draws.collect()))
    assert {r.metric: r.replicates for r in bootstrap.intervals(draws).collect()} == dict.fromkeys(bootstrap.METRICS, 600)
    assert bootstrap.metric_deltas(pairs.limit(0), labels, 10).count() == 0


def test_pairs_must_be_of_the_same_rows(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, expected string, v int")
    assert [tuple(r) for r in reports.paired(a, a, ["k"], "expected").select("k", "expected", "base_v", "new_v").orderBy("k").collect()] == [(1, "x", 5, 5), (2, "y", 6, 6)]
    with pytest.raises(Exception, match="only one side has the row 2"):
        reports.paired(a, a.where("k = 1"), ["k"], "expected").collect()
    with pytest.raises(Exception, match="expected differs at 2"):
        reports.paired(a, a.withColumn("expected", F.lit("x")), ["k"], "expected").collect()


def test_releases_and_look_ups_refuse_unknown_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    verdicts = lambda *ks: spark.createDataFrame([(k, ok) for k, ok in ks], "k long, accepted boolean")
    assert sorted(r.k for r in reports.released(rows, verdicts((1, False), (2, True)), "k").collect()) == [2, 3]
    with pytest.raises(Exception, match="unknown rows, the first on 9"):
        reports.released(rows, verdicts((1, False), (9, True)), "k").collect()
    names = spark.createDataFrame([(0, 2), (1, 1)], "pos int, k long")
    assert [tuple(r) for r in reports.looked_up(names, rows, "k", "v").orderBy("pos").select("pos", "v").collect()] == [(0, "b"), (1, "a")]
    with pytest.raises(Exception, match="no row has k 7"):
        reports.looked_up(names.union(spark.createDataFrame([(2, 7)], names.schema)), rows, "k", "v").collect()


def test_finalized_release_counts_unknown_verdicts(spark, tmp_path):
    spark.createDataFrame([(1, "de"), (2, "de"), (3, "en")], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (8, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = finalized_release(spark, str(tmp_path)).orderBy("lang").collect()
    assert [(r.lang, r.n, r.ids, r.unknown) for r in got] == [("de", 1, 2, 2), ("en", 1, 3, 2)]


# --- Sets


def test_set_changes_are_those_of_sets(spark):
    values = [None, 1, 2, 3]
    for a, b in itertools.product([[1, 1, 1, 2], [None, 1, 1], [], [3]], [[1, 3], [None], []]):
        left, right = (spark.createDataFrame([(v,) for v in x], "k int") for x in (a, b))
        want = {(v, "gone") for v in values if v in a and v not in b} | {(v, "new") for v in values if v in b and v not in a}
        assert set(map(tuple, reports.set_changes(left, right, "k").collect())) == want
