"""Scans, manifests, sinks, ranks and digests on small files and tables."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import ranks, rebuilds, similarity
from lexloom.sources import manifests, tables, writers


@pytest.fixture
def small_splits(spark):
    """Text files in splits of few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path, small_splits):
    rng = random.Random(2)
    lines = {f"f{k}.txt": ["x" * rng.choice([0, 1, 30, 90]) + str(i) if rng.random() < 0.8 else "" for i in range(40)] for k in range(3)}
    for name, ls in lines.items():
        (tmp_path / name).write_text("\n".join(ls) + "\n")
    found = tables.numbered(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 6
    got = {(r.file.rsplit("/", 1)[1], r.line): r.raw for r in found.collect()}
    assert got == {(name, i + 1): line for name, ls in lines.items() for i, line in enumerate(ls)}


def test_samples_say_where_they_are_wrong(spark, tmp_path, small_splits):
    good = {"sample": {"id": "a", "utt": "hello"}}
    lines = [good, "", {"sample": 5}, {"other": 1}, {"sample": {"utt": "x"}}, {"sample": {"id": "", "utt": "x"}}, {"sample": {"id": "b", "utt": " 　"}}, {"sample": {"id": 5, "utt": "x"}}, "no json", {"sample": {"id": "c", "utt": 7}}]
    (tmp_path / "in.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    found = tables.samples(spark, str(tmp_path / "in.jsonl"))
    assert [(r.line, r.problem) for r in found.orderBy("line").collect()] == [
        (1, None), (3, "missing sample object"), (4, "missing sample object"), (5, "missing sample id"), (6, "missing sample id"),
        (7, "missing utterance"), (8, "missing sample id"), (9, "not JSON"), (10, "missing utterance"),
    ]
    with pytest.raises(ValueError, match=r"missing sample object at .*in\.jsonl:3; "):
        tables.required(found)
    (tmp_path / "twice.jsonl").write_text("\n".join([json.dumps(good)] * 2))
    with pytest.raises(ValueError, match="repeated keys: a"):
        tables.required(tables.samples(spark, str(tmp_path / "twice.jsonl")), "id")
    (tmp_path / "once.jsonl").write_text(json.dumps(good))
    assert tables.required(tables.samples(spark, str(tmp_path / "once.jsonl")), "id").count() == 1


def test_manifest_guards_a_scan(spark, tmp_path):
    rows = [{"id": k, "only": True} for k in range(5)]
    path = tmp_path / "probe.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    manifest = manifests.manifest_of(spark, str(path), 5)
    assert manifest["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    read = manifests.document(spark, str(tmp_path / "m.json"))
    assert read == manifest and manifests.document(spark, str(tmp_path / "none.json")) is None
    schema = "id BIGINT, only BOOLEAN"
    assert sorted(r.id for r in manifests.verified(spark, str(path), schema, read, "only").collect()) == list(range(5))
    for change, message in (({"rows": 4}, "5 rows"), ({"sha256": "0"}, "digest"), ({"status": "draft"}, "ready")):
        with pytest.raises(ValueError, match=message):
            manifests.verified(spark, str(path), schema, manifest | change, "only")
    path.write_text(path.read_text().replace("true", "false", 1))
    with pytest.raises(ValueError, match="digest"):
        manifests.verified(spark, str(path), schema, manifest, "only")
    with pytest.raises(ValueError, match="1 lack only"):
        manifests.verified(spark, str(path), schema, manifests.manifest_of(spark, str(path), 5), "only")


def test_tree_of_files_changes_with_paths_and_contents(spark, tmp_path):
    for k in range(5):
        (tmp_path / "t" / f"d{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / f"d{k % 2}" / f"f{k}").write_text(f"text {k}")
    folder = str(tmp_path / "t")
    before = spark.createDataFrame(manifests.files(spark, folder).collect())
    assert sorted(r.path for r in before.collect()) == ["d0/f0", "d0/f2", "d0/f4", "d1/f1", "d1/f3"]
    digest = manifests.tree(before).first().digest
    assert manifests.tree(manifests.files(spark, folder)).first().digest == digest
    (tmp_path / "t" / "d1" / "f1").write_text("other")
    (tmp_path / "t" / "d0" / "f0").rename(tmp_path / "t" / "d0" / "f9")
    after = manifests.files(spark, folder)
    assert manifests.tree(after).first().digest != digest
    assert sorted(map(tuple, manifests.differing(after, before).collect())) == [("d0/f0", "gone"), ("d0/f9", "new"), ("d1/f1", "changed")]


# --- Ranks and digests


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranks_are_those_of_one_sorted_list(spark, partitions):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.randrange(20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(partitions)
    got = {r.i: r.place for r in ranks.ranked(df, F.desc("x"), "i", name="place").collect()}
    assert got == {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    within = ranks.ranked_within(df, "g", "x", "i", start=0, size="n").collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [(r.i, r.n) for r in sorted((r for r in within if r.g == g), key=lambda r: r["rank"])] == [(r[2], len(mine)) for r in mine]
    assert ranks.ranked(df.limit(0), "i").count() == 0


def digest_by_hand(values, fan):
    level = [hashlib.sha256(v.encode()).hexdigest() for v in values]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_tree_digest_is_the_same_on_any_partitioning(spark, monkeypatch, fan):
    monkeypatch.setattr(ranks, "FAN", fan)
    rows = [("one", 0, "x")] + [("many", k, f"v{k}") for k in range(50)] + [(None, k, f"w{k}") for k in range(4)]
    want = {g: digest_by_hand([v for h, _, v in rows if h == g], fan) for g in ("one", "many", None)}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "g string, k int, v string").repartition(parts)
        assert {r.g: r.digest for r in ranks.tree_digest(df, F.col("v"), "k", group="g").collect()} == want
    assert ranks.tree_digest(df.where("g = 'many'"), F.col("v"), "k").first().digest == want["many"]
    assert ranks.tree_digest(df.limit(0), F.col("v"), "k").count() == 0


# --- Reports made again


def test_changed_numbers_are_named(spark):
    told = {"a": {"n": 3, "mean": 0.1 + 0.2, "name": "x", "ok": True}, "list": [1, {"v": 2.5}]}
    assert rebuilds.numbers(told) == [("a.n", 3.0), ("a.mean", 0.1 + 0.2), ("list.0", 1.0), ("list.1.v", 2.5)]
    found = spark.createDataFrame([("a.n", 3.0), ("a.mean", 0.3), ("list.0", 1.0), ("more", None)], "path string, value double")
    wrong = rebuilds.compared(found, rebuilds.published(spark, told)).collect()
    assert sorted((r.path, r.problem) for r in wrong) == [("list.1.v", "not found"), ("more", "not told")]
    changed = rebuilds.published(spark, {"a": {"n": 4, "mean": 0.3}, "list": [1], "more": 1})
    with pytest.raises(ValueError, match=r"2 numbers don't agree: a\.n differs \(found 3\.0, told 4\.0\); more differs"):
        rebuilds.verified(found, changed)
    rebuilds.verified(found.where("value IS NOT NULL"), rebuilds.published(spark, {"a": {"n": 3.2, "mean": 0.3}, "list": [1]}), absolute=0.25)


def test_named_paths(spark):
    rows = spark.createDataFrame([("g", 1, 0.5), ("g", None, 1.5)], "grp string, seed int, acc double")
    assert sorted(map(tuple, rebuilds.named(rows, "r", ["grp", "seed"], ["acc"]).collect())) == [("r.g.1.acc", 0.5), ("r.g.null.acc", 1.5)]


# --- Sinks


def test_keys_are_appended_once_over_restarts(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema("id long, v string").parquet(source)
        writers.append_once(stream, "id", out, check).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("id").collect()), key=str)

    put = lambda rows: spark.createDataFrame(rows, "id long, v string").write.mode("append").parquet(source)
    put([(1, "a"), (1, "a"), (2, "b")])
    assert run() == [(1,), (2,)]
    assert run() == [(1,), (2,)]
    put([(2, "again"), (3, "c"), (None, "d"), (None, "e")])
    assert len(run()) == 4
    assert spark.read.parquet(out).where("id = 2").first().v == "b"


def test_ledger_sums_sessions(spark, tmp_path):
    out = str(tmp_path / "ledger")
    df = lambda rows: spark.createDataFrame(rows, "session string, seconds double")
    writers.ledger(df([("a", 1.0), ("b", 2.0)]), out)
    assert sorted(map(tuple, writers.ledger(df([("a", 0.5)]), out).collect())) == [("a", 2, 1.5), ("b", 1, 2.0)]


def test_release_is_written_only_if_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", None)], "id long, g string, t string")
    out = str(tmp_path / "r")
    with pytest.raises(ValueError, match="y: 1 rows for 2"):
        writers.release(rows, "id", "g", {"x": 2, "y": 2}, out)
    with pytest.raises(ValueError, match="repeated keys: 1"):
        writers.release(rows.union(rows.where("id = 1")), "id", "g", {"x": 3, "y": 1}, out)
    assert not (tmp_path / "r").exists()
    written = writers.release(rows, "id", "g", {"x": 2, "y": 1}, out).collect()
    assert all(r.digest == hashlib.sha256((tmp_path / "r" / r.path).read_bytes()).hexdigest() for r in written)
    assert sorted(map(tuple, tables.json_lines(spark, out, "id BIGINT, g STRING, t STRING").select("id", "g", "t").collect())) == [(1, "x", "a"), (2, "x", "b"), (3, "y", None)]


def test_outcomes_have_folders_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "F1")], "id long, reject_reason string")
    writers.outcomes(rows, str(tmp_path / "o"))
    assert {p.name for p in (tmp_path / "o").iterdir() if p.is_dir()} == {"outcome=accepted", "outcome=rejected"}


def test_coded_columns_and_delimited_lines_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(0, "a\x1fb"), (1, "a"), (7, "a\x1fb\x1fc"), (None, None)], "code int, line string")
    assert [r.code for r in tables.decoded(df, "code", ["zero", "one"]).collect()] == ["zero", "one", None, None]
    got = [r.x for r in df.select(tables.delimited(F.col("line"), "\x1f", ["p", "q"]).alias("x")).collect()]
    assert [x and tuple(x) for x in got] == [("a", "b"), None, None, None]
    for name, n in (("train", 3), ("test", 2)):
        spark.range(n).write.parquet(str(tmp_path / name))
    both = tables.splits(spark, str(tmp_path), ["train", "test"], "id BIGINT")
    assert {r.split: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 3, "test": 2}


def test_unions_refuse_repeated_ids(spark):
    a, b = spark.range(3), spark.range(3, 5)
    assert similarity.unioned([a, b]).count() == 5
    with pytest.raises(Exception, match="an id occurs twice"):
        similarity.unioned([a, b, spark.range(1)]).collect()


def test_checkpoints_and_predictions_are_whole_and_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_LINES", 3)
    schema, path = "k BIGINT, v STRING", tmp_path / "c.jsonl"

    def write(*lines):
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps({"k": x, "v": "v"}) for x in lines) + "\n")
        return str(path)

    assert sorted(r.k for r in tables.checkpointed(spark, write(5, "", 3), schema, "k").collect()) == [3, 5]
    for lines, message in (((5, 3, 5), "repeated keys: 5"), ((5, "no"), r"can't be read at .*c\.jsonl:2"), ((5, '{"v": "x"}'), "no k at")):
        with pytest.raises(ValueError, match=message):
            tables.checkpointed(spark, write(*lines), schema, "k")
    assert sorted(r.k for r in tables.predictions(spark, write(0, 1, "", "", "", 2, 3, 4, "", 5, 6, 7, 8), schema, "k").collect()) == list(range(9))
    for lines, message in (((0, 2, 1), r"index 2 out of order at .*:2"), ((0, 1, 1), "index 1 out of order"), ((1, 2), "index 1 out of order at .*:1"), ((0, "x"), "can't be read")):
        with pytest.raises(ValueError, match=message):
            tables.predictions(spark, write(*lines), schema, "k")


def test_tables_are_replaced_when_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(k % 5, k, f"v{k}") for k in range(40)], "key int, at int, v string")
    rows.write.parquet(path)
    writers.compact(spark.read.parquet(path), "key", "at", path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(k, 35 + k, f"v{35 + k}") for k in range(5)]
    with pytest.raises(Exception, match="stop"):
        writers.replace(rows.withColumn("v", F.raise_error(F.lit("stop")).cast("string")), path)
    assert spark.read.parquet(path).count() == 5
    for value in ({"b": [1, None], "a": "ü"}, {"other": 2}):
        writers.document(spark, value, str(tmp_path / "doc"))
        assert manifests.document(spark, str(tmp_path / "doc")) == value
    writers.replace(rows, str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new")).count() == 40 and not [p for p in tmp_path.iterdir() if ".old-" in p.name]
