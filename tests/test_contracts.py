"""Contracts, examples, archives and plug-ins on small tables; every error occurs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexloom.operators import contracts, plugins
from lexloom.plans.contracts import histogram
from lexloom.sources import examples


def test_observed_groups_and_their_drift(spark):
    rows = [("a", 1, "x", "t1"), ("a", 2, "x", "t2"), ("a", 3, "y", "t3"), ("b", 1, "x", "t1")]
    kind = "g string, id long, l string, t string"
    df = spark.createDataFrame(rows, kind)
    seen = {r.g: r for r in contracts.observed(df.repartition(3), "g", "id", "l", F.col("t")).collect()}
    assert tuple(seen["a"])[1:-1] == (3, 3, 2, 1, 2) and tuple(seen["b"])[1:-1] == (1, 1, 1, 1, 1)
    once = lambda t: hashlib.sha256(hashlib.sha256(t.encode()).hexdigest().encode()).hexdigest()
    assert seen["b"].digest == once("t1") and seen["a"].digest == hashlib.sha256("\n".join(map(once, ["t1", "t2", "t3"])).encode()).hexdigest()
    other = spark.createDataFrame([*rows[:2], ("a", 3, "y", "changed"), ("a", 3, "y", "t3"), ("c", 1, "x", "t")], kind)
    parts = ("rows", "unique_ids", "digest")
    found = {(r.g, r.part): (r.was, r["is"]) for r in contracts.drift(contracts.observed(other, "g", "id", "l", F.col("t")), contracts.observed(df, "g", "id", "l", F.col("t")), "g", *parts).collect()}
    assert found["a", "rows"] == ("3", "4") and ("a", "unique_ids") not in found and ("a", "digest") in found
    assert found["b", "rows"] == ("1", None) and found["c", "rows"] == (None, "1")


def test_additions_are_fair_only_if_equal_and_all_there(spark):
    sizes = spark.createDataFrame([("base", 10), ("p", 15), ("q", 15), ("r", 14)], "g string, rows long")
    found = lambda names: sorted(map(tuple, contracts.additions(sizes, "g", "base", names).collect()))
    assert found(["p", "q"]) == [("p", 5, True), ("q", 5, True)]
    assert found(["p", "r"]) == [("p", 5, False), ("r", 4, False)]
    assert found(["p", "none"]) == [("p", 5, False)]


def test_labels_drift_and_reports_are_whole(spark):
    labels = spark.createDataFrame([("a",), ("a",), ("c",)], "l string")
    assert sorted(map(tuple, contracts.label_drift(labels, "l", ["a", "b"]).collect())) == [("b", "gone"), ("c", "new")]
    rows = spark.createDataFrame([("m", 3, 3), ("m", 2, 3), ("x", 3, 3), ("m", None, 3)], "mode string, completed int, target int")
    whole = rows.select(contracts.complete(rows, "m").alias("a"), contracts.complete(rows, "m", 4).alias("b")).collect()
    assert [r.a for r in whole] == [True, False, False, False] and not any(r.b for r in whole)


def test_unstable_labels_break_ties_by_name(spark):
    rows = [(s, label, base, new) for label, pairs in {"b": [(10.0, 20.0), (30.0, 30.0)], "a": [(30.0, 0.0), (10.0, 10.0)], "c": [(5.0, 5.0), (5.0, 6.0)]}.items() for s, (base, new) in enumerate(pairs)]
    found = contracts.unstable(spark.createDataFrame(rows, "seed int, l string, base double, new double"), "l", 2)
    assert sorted(map(tuple, found.collect())) == [("range", 1, "a", 20.0), ("range", 2, "b", 20.0), ("swing", 1, "a", 30.0), ("swing", 2, "b", 10.0)]


def test_config_keys_are_replaced(spark):
    df = spark.createDataFrame([('{"b": [1, "x"], "a": {"q": null}}',), ('{"k": "old", "z": "\\"q"}',), ("[1]",), ("no",), (None,)], "c string")
    assert [r.x for r in df.select(contracts.overridden(F.col("c"), "k", 'new "v"').alias("x")).collect()] == [
        '{"a":{"q":null},"b":[1,"x"],"k":"new \\"v\\""}', '{"k":"new \\"v\\"","z":"\\"q"}', None, None, None,
    ]


def test_table_lines(spark):
    df = spark.createDataFrame([("b|c", 0.5, None), ("a", 1.0, 3)], "name string, x double, n int")
    assert contracts.table_lines(df, ["name", "x", "n"], ["name"]) == ["| name | x | n |", "|---|---|---|", "| a | 1.0000 | 3 |", "| b\\|c | 0.5000 | – |"]


def test_histogram_marks_the_bin_of_the_percentile(spark):
    df = spark.createDataFrame([("g", x) for x in (-0.5, 0.0, 0.5, 0.5, 1.0)] + [("h", 0.1)], "g string, x double")
    assert sorted(map(tuple, histogram(df, "g", F.col("x"), 4).collect())) == [("g", 0, 1, False), ("g", 1, 1, False), ("g", 3, 2, False), ("g", 5, 1, False), ("h", 1, 1, True)]


def test_examples_of_annotated_rows(spark):
    kind = "id long, intent int, annot_utt string"
    good = spark.createDataFrame([(3, 1, "wake me at [time : six]"), (1, 0, "hello")], kind)
    got = [tuple(r) for r in examples.from_annotated(good, ["greet", "alarm"], "validation:").collect()]
    assert sorted((i, u, n, [tuple(s) for s in ss]) for i, u, n, ss in got) == [("validation:1", "hello", "greet", []), ("validation:3", "wake me at six", "alarm", [("time", "six")])]
    assert [r.id for r in examples.from_annotated(good, ["greet", "alarm"], limit=1).collect()] == ["1"]
    assert examples.from_annotated(good, ["greet", "alarm"]).select(examples.expected().alias("e")).first().e.utt
    for row, message in (((5, 0, "bad [x"), "row 5: unread bracket"), ((6, 9, "fine"), "row 6: unknown intent"), ((7, 0, "[time :  ]"), "row 7")):
        with pytest.raises(Exception, match=message):
            examples.from_annotated(spark.createDataFrame([row], kind), ["greet", "alarm"]).collect()


def test_vector_archives_are_checked_before_they_are_read(spark, tmp_path):
    kind, path = "id string, role string, ord long, vec array<double>", str(tmp_path / "v")
    rows = [("a", "seed", 0, [1.0, 0.0]), ("b", "seed", 1, [0.0, 1.0]), ("c", "eval", 0, [1.0, 1.0])]

    def read(changed, **more):
        examples.write_vectors(spark.createDataFrame(changed, kind), path)
        return examples.read_vectors(spark, path, ("seed", "eval"), **more)

    ids = {"seed": spark.createDataFrame([("a", 0), ("b", 1)], "id string, ord long")}
    assert sorted((r.id, r.role, r.ord) for r in read(rows, ids=ids).collect()) == [("a", "seed", 0), ("b", "seed", 1), ("c", "eval", 0)]
    for changed, message in ((rows[:2], "no vectors of eval"), ([*rows[:2], ("c", "eval", 0, [1.0])], "different lengths"), ([rows[0], ("b", "seed", 2, [0.0, 1.0]), rows[2]], "places of seed"), ([rows[0], ("b", "seed", 0, [0.0, 1.0]), rows[2]], "places of seed")):
        with pytest.raises(ValueError, match=message):
            read(changed)
    with pytest.raises(ValueError, match="seed at 1 is x, not b"):
        read([rows[0], ("x", "seed", 1, [0.0, 1.0]), rows[2]], ids=ids)


def test_backends_are_called_with_texts_of_a_batch(spark):
    def lengths():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    assert {r.id: r.vec for r in plugins.encoded(df, "t", lengths).collect()} == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert {r.id: r.said for r in plugins.encoded(df, "t", lambda: lambda texts: [t.upper() for t in texts], "said", "string").collect()} == {1: "AB", 2: None, 3: ""}
    with pytest.raises(Exception, match="0 results for"):
        plugins.encoded(df, "t", lambda: lambda texts: []).collect()


def test_filters_by_name(spark):
    known = plugins.Filters().add("short", lambda: F.when(F.length("t") < 2, "too short")).add("none", lambda: F.when(F.col("t").isNull(), "missing"))
    df = spark.createDataFrame([("abc",), ("a",), (None,)], "t string")
    assert [tuple(r) for r in known.applied(df).collect()] == [("abc", None, None), ("a", "short", "too short"), (None, "none", "missing")]
    assert [r.filter for r in known.applied(df, "none").collect()] == [None, None, "none"]
    with pytest.raises(ValueError, match="no filter other"):
        known.applied(df, "other")
    with pytest.raises(ValueError, match="there already"):
        known.add("short", lambda: F.lit(None))
    assert known.names() == ["short", "none"]
