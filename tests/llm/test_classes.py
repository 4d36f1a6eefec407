"""Benchmark items of one template, and phrases that many items share, bring no pairs of all with all."""

import random

from lexloom.llm import decontamination

NAMES = "Anna Bob Carla Dora Emil Frida Gustav Hanna Ivan Jana Karl Lena".split()


def counted(written, seen):
    """written() that notes how many rows it wrote."""

    def note(df, name):
        out = written(df, name)
        seen[name] = out.count()
        return out

    return note


def story(rng):
    a, b = rng.sample(NAMES, 2)
    x, y = rng.sample(range(10, 99), 2)
    return f"yesterday {a} bought {x} apples at the market and gave {y} apples to her old friend {b} who then went home with {x} apples and told {a} about it"


def test_items_of_one_template_are_matched_once(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, story(rng)) for k in range(40)] + [(90, story(rng).replace("home with", "home without"))]
    docs = [(k, f"Some text before. {story(rng)}. And after it.") for k in range(40)] + [(50, "nothing of the kind is said in this text of a few words")]
    # Another pattern of equal values: the same number twice where items have two.
    docs.append((51, "yesterday Anna bought 12 apples at the market and gave 12 apples to her old friend Bob who then went home with 12 apples and told Anna about it"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    seen = {}
    monkeypatch.setattr(decontamination, "written", counted(decontamination.written, seen))
    leaks = decontamination.contaminated(d, b).collect()
    assert {r.doc_id for r in leaks} == set(range(40))
    assert {(r.item_id, r.n_items) for r in leaks if r.item_id != 90} == {(0, 40)}
    assert seen["hits"] < 4 * seen["windows"]
    members = {r.item_id: r.class_id for r in decontamination.item_classes(b).collect()}
    assert members == dict.fromkeys(range(40), 0) | {90: 90}


def test_a_phrase_of_many_items_brings_nothing_together(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    phrase = " ".join(word() for _ in range(14))
    items = [(k, " ".join(word() for _ in range(12)) + f" {phrase} " + " ".join(word() for _ in range(12))) for k in range(30)]
    docs = [(k, " ".join(word() for _ in range(30)) + f" {phrase} " + " ".join(word() for _ in range(9))) for k in range(30)] + [(100 + k, f"{word()} {t} {word()}") for k, t in items[:3]]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for few in (50_000, 0):
        monkeypatch.setattr(decontamination, "FEW", few)
        seen = {}
        monkeypatch.setattr(decontamination, "written", counted(decontamination.written, seen))
        assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()} == {(100 + k, k) for k in range(3)}
        assert seen["hits"] < 200
        monkeypatch.undo()


def test_numbers_of_other_languages_are_slots(spark):
    item = "am Morgen kaufte jemand zwölf reife birnen auf dem markt und gab davon sieben an die leute weiter die mit dem wagen kamen und nach zwei stunden wieder fuhren"
    told = item.replace("zwölf", "30").replace("sieben", "neun").replace("zwei", "vier")
    d = spark.createDataFrame([(1, f"Dann: {told} sagte er"), (2, "ganz anders")], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]
