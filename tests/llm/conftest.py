import random

import pytest

WORDS = "the of and a to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "tion", "er"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def changed(rng: random.Random, t: str, k: int) -> str:
    words = t.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Random texts, exact and near copies, shared passages, and odd rows."""
    rng = random.Random(11)
    texts = [text(rng, rng.choice([3, 12, 40, 120, 400])) for _ in range(60)]
    base = text(rng, 90)
    passage = text(rng, 30)
    texts += [changed(rng, base, k) for k in (0, 1, 2, 3, 4, 5, 6, 8, 12, 20)]
    texts += [texts[4], texts[9], texts[9], texts[30] + " " + passage, passage + " " + texts[31], texts[32][:60] + passage + texts[33][:80]]
    texts += ["", " \n\t ", "one", "Überall ß 視頻 \U0001f600 äöü " * 12, "a " * 300, "\n".join([text(rng, 8)] * 3), None]
    return list(enumerate(texts))


@pytest.fixture
def documents(spark, corpus):
    rows = [(i, t, "en", f"src{i % 3}") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
