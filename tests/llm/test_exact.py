"""Each operator against a brute-force version, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import anchors, chat, components, decontamination, line_dedup, near_duplicates, packing, quality_classifier, quality_rules, queries, substring_dedup, suffix_dedup, token_counts, tokens


def removed_by_force(corpus, cut, n):
    seen, out = {}, {}
    for i, t in corpus:
        units, gone = cut(t or ""), set()
        for s in range(len(units) - n + 1):
            if seen.setdefault(tuple(units[s : s + n]), i) < i:
                gone.update(range(s, s + n))
        out[i] = [u for k, u in enumerate(units) if k not in gone]
    return out


def test_suffix_array_dedup(documents, corpus):
    want = removed_by_force(corpus, lambda t: list(t.encode()), 50)
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(documents).collect()}
    assert {i: list(r.kept) for i, r in got.items()} == want
    assert all(r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans) for r in got.values())


def test_fm_index_dedup(documents, corpus):
    want = removed_by_force(corpus, lambda t: t.encode().split(), 13)
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.deduplicated(documents).collect()}
    assert got == {i: b" ".join(w) for i, w in want.items()}


def digests_by_force(corpus, cut, n, joined):
    """n_units, n_removed, spans and digest per document."""
    seen, out = {}, {}
    for i, t in corpus:
        units, gone = cut(t or ""), set()
        for s in range(len(units) - n + 1):
            if seen.setdefault(tuple(units[s : s + n]), i) < i:
                gone.update(range(s, s + n))
        spans = sum(k - 1 not in gone for k in gone)
        out[i] = (len(units), len(gone), spans, hashlib.sha256(joined([u for k, u in enumerate(units) if k not in gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 500])
def test_digest_columns_of_both_dedups(documents, corpus, hot, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = queries._removed(suffix_dedup.deduplicated(documents), "n_bytes").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == digests_by_force(corpus, lambda t: list(t.encode()), 50, bytes)
    rows = queries._removed(substring_dedup.deduplicated(documents), "n_words").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == digests_by_force(corpus, lambda t: t.encode().split(), 13, b" ".join)


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_dedup_of_odd_tables(spark, operator):
    schema = "doc_id long, text string, kept string, removed int"
    assert operator.deduplicated(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 40
    rows = [(1, long, "k", 1), (1, long, "k", 1), (None, long, None, None), (2, long, None, 3)]
    got = sorted(((r.doc_id or 0, len(r.kept)) for r in operator.deduplicated(spark.createDataFrame(rows, schema)).collect()))
    full = len(long) if operator is suffix_dedup else len(long) - 1
    assert got == [(0, full), (1, full), (1, full), (2, 0)]


def test_suffix_array_is_right_and_spills():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000, dtype=np.uint8)
    ends = np.array([999, 1999, 2999])
    raw[ends] = 0
    small = lambda: suffix_dedup.SuffixQueues(bound=64)
    got = suffix_dedup.suffix_array(raw, ends, suffix_dedup.words_at(raw, 56), 56, small)
    text = [0 if k in ends else int(c) + 1 for k, c in enumerate(raw)]
    assert sorted(got.tolist()) == list(range(3000))
    keys = [tuple(text[p : p + 56]) for p in got.tolist()]
    assert keys == sorted(keys)


def test_wavelet_ranks_and_backward_search():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(1, 9, 500), 0)
    tree = substring_dedup.WaveletTree(symbols)
    s, at = rng.integers(0, 9, 200), rng.integers(0, 502, 200)
    assert tree.rank(s, at).tolist() == [int((symbols[:a] == c).sum()) for c, a in zip(s, at)]
    index, asked = substring_dedup.FMIndex(symbols, 4), np.array([symbols[k : k + 3] for k in range(400)])
    want = [sum(symbols[j : j + 3].tolist() == symbols[k : k + 3].tolist() for j in range(499)) for k in range(400)]
    for least in (0, 2, 4, 500):
        row, low, high = index.search(asked, least)
        assert row.tolist() == [k for k, n in enumerate(want) if n >= least] and (high - low).tolist() == [n for n in want if n >= least]


def test_anchor_is_a_function_of_the_window():
    unit = anchors.Unit(20, 6, None, lambda u: u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 50, 60)
    a, b = np.concatenate([rng.integers(0, 50, 33), shared]), np.concatenate([shared, rng.integers(0, 50, 40)])
    which, start, count, hashes = anchors.segments_of([a, b], unit)
    at = {(w, s + k): h for w, s, c, h in zip(which, start, count, hashes) for k in range(c)}
    assert len(at) == len(a) + len(b) - 38
    assert all(at[0, 33 + k] == at[1, k] for k in range(41))


def components_by_force(corpus, size, percent=80):
    sets = {}
    for i, t in corpus:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [{}, {"block_members": 3}])
def test_near_duplicates(documents, corpus, blocks):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(documents, 4, 80, **blocks).collect()}
    assert got == components_by_force(corpus, 4)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string, grp string, keys int"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (None, "a b c d e f", None, 2), (7, None, None, 3), (8, "A B C D E F", None, 4)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates.near_duplicates(df).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 7, True), (8, 5, False)]
    assert sorted(r.doc_id or 0 for r in near_duplicates.deduplicated(df).collect()) == [0, 5, 7]


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = (near_duplicates.registers(np.unique(np.concatenate([both, z]))) for z in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.15
    z = near_duplicates.registers(rng.integers(0, 2**64, 900, dtype=np.uint64))
    assert (x == z).mean() < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_force(corpus):
    first, occurrences = {}, []
    for i, t in corpus:
        for k, line in enumerate((t or "").split("\n")):
            if line := line.strip(line_dedup.BLANK).lower():
                first.setdefault(line, (i, k))
                occurrences.append((i, k, line))
    lines = list(first)
    sets = [{x[j : j + 5] for j in range(max(1, len(x) - 4))} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    keep = {}
    for k, line in enumerate(lines):
        keep[find(k)] = min(keep.get(find(k), (10**9, 0)), first[line])
    number = {x: k for k, x in enumerate(lines)}
    return {(i, k) for i, k, x in occurrences if keep[find(number[x])] != (i, k)}


def test_line_dedup(documents, corpus):
    rows = {(r.doc_id, r.line_no) for r in line_dedup.removals(documents).collect()}
    want = lines_by_force(corpus)
    assert rows <= want and len(rows) >= 0.97 * len(want)


def test_line_dedup_of_odd_tables(spark):
    schema = "doc_id long, text string, n_lines string"
    assert line_dedup.without_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "Some line here\n\nother text", "x"), (2, "some line here \nfresh words", "x"), (3, None, None), (None, "some line here", None)]
    out = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: "Some line here\n\nother text", 2: "fresh words", 3: None, None: "some line here"}


def test_line_dedup_of_blanks_clashing_columns_and_repeated_ids(spark):
    schema = "doc_id long, text string, n_lines string, n_removed string, removed_from string, line string"
    more = ("a", "b", "c", "d")
    rows = [(1, "\t \nx marks\ny marks", *more), (1, "z marks\nx marks", *more), (6, "\t \n\u000b\n", *more), (7, "x marks\n" + "long words " * 60_000, *more), (8, "long words " * 50_000, *more)]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert all(tuple(r)[2:] == more for r in out)
    texts = sorted((r.doc_id, r.text[:30]) for r in out)
    kept_once = [t for i, t in texts if i == 1]
    assert sum("x marks" in t for t in kept_once) == 1 and sum("y marks" in t for t in kept_once) == 1 and sum("z marks" in t for t in kept_once) == 1
    assert texts[2:] == [(6, "\t \n\u000b\n"), (7, ("long words " * 3)[:30]), (8, "")]


def test_line_dedup_minima_have_high_recall():
    rng = random.Random(8)
    for n in (8, 14, 30, 60, 90, 200, 700):
        pairs = []
        for _ in range(150):
            a = "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(n))
            b = a
            while len(line_dedup.shingle_set(a) & (s := line_dedup.shingle_set(c := b[: (i := rng.randrange(len(b)))] + "x" + b[i + 1 :]))) >= 0.8 * len(line_dedup.shingle_set(a) | s):
                b = c
            pairs.append((a, b))
        one, two = (line_dedup.minima(list(x)) for x in zip(*pairs, strict=True))
        (k, has), (m, also) = line_dedup.band_keys(*one), line_dedup.band_keys(*two)
        assert ((k == m) & has & also).any(1).mean() > 0.97


def test_line_dedup_finds_lines_of_any_script(spark):
    rng = random.Random(4)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(90)) + "\U0001f600" * 3
    url = "https://example.org/" + "".join(rng.choice("abcdefghij0123456789/") for _ in range(90))
    short = " ".join(rng.choice("abcdefghijklmnop") for _ in range(120))
    tabbed = "\t".join(str(rng.randrange(100)) for _ in range(60)) + "\r"
    pairs = [("-" * 40, "-" * 41), (chinese, chinese[:-1]), (thai, thai[:40] + thai[41:]), (url, url + "#x"), (short, short[:-1] + "!"), (tabbed, "9" + tabbed)]
    corpus = [(10 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    rows = {(r.doc_id, r.line_no) for r in line_dedup.removals(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert rows == lines_by_force(corpus) == {(10 * i + 1, 0) for i in range(len(pairs))}


def test_token_ids_and_counts():
    json = tokens.tokenizer_json()
    whole, own = Tokenizer.from_str(json), tokens.Encoder(json)
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "a", "the", "'s", "1", "é", "\x1c", " ", ".", "!!", "　", "<|endoftext|>", "fox", "\t"]
    for _ in range(400):
        s = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert np.frombuffer(own.ids(s), "<u4").tolist() == whole.encode(s, add_special_tokens=False).ids
        tree = token_counts.CountTree(s, own)
        for _ in range(3):
            a, b, new = rng.randint(-1, len(s) + 1), rng.randint(0, len(s) + 2), "".join(rng.choices(bits, k=rng.randint(0, 4)))
            tree.edit(a, b, new)
            a = min(max(a, 0), len(s))
            s = s[:a] + new + s[min(max(b, a), len(s)) :]
            assert tree.text == s and tree.n_tokens == len(whole.encode(s, add_special_tokens=False).ids)


def test_counts_of_documents(documents, corpus):
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    size = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    edits = token_counts.cleaning_edits(F.coalesce("text", F.lit("")), F.lit("# x\n"))
    got = {r.doc_id: r for r in token_counts.counted(documents, edits).collect()}
    assert all((r.n_tokens, r.n_tokens_after) == (size(t or ""), size("# x\n" + (t or ""))) for r, t in ((got[i], t) for i, t in corpus))
    mail = documents.limit(1).select("doc_id", F.lit("write to a.b@c.de or 10.0.0.1 now").alias("text"))
    r = token_counts.counted(mail, token_counts.cleaning_edits(F.col("text"), F.lit(""))).first()
    assert r.n_edits == 3 and r.n_tokens_after == size("write to [address] or [address] now")


def test_packing(documents, corpus):
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    got = packing.packed_documents(documents.repartition(9), length=64).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in corpus}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids[i])
        assert all(r.length == 64 for r in rows[1:])
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 64
    assert len(by_sequence) <= 1.05 * sum(map(len, ids.values())) / 64 + 1
    assert packing.packed_documents(documents.where("false")).count() == 0


def test_quality_measures(documents, corpus):
    got = {r.doc_id: r for r in quality_rules.measured(documents).collect()}
    for i, t in corpus:
        words = (t or "").split() if "\x1c" not in (t or "") else None
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 500 else None
        r = got[i]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and (again is None or r.n_repeat_words == len(again))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.keep_good(documents).columns == documents.columns
    odd = quality_rules.measured(documents.limit(1).select("doc_id", F.expr("repeat(sha2('a', 512), 40)").alias("text"), F.lit(1).alias("kept"))).first()
    assert odd.zstd_ratio < 0.1 and not odd.kept


def test_quality_scores_learn_from_allowed_rows_only(spark):
    load = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs, labels = load("documents"), load("labels")
    out = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs, labels, ~out)
    spoiled = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(model.weights, quality_classifier.train(docs, spoiled, ~out).weights)
    hit = quality_classifier.scored(docs, model).join(labels, "doc_id").where(out)
    assert hit.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    odd = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert len({r.score for r in quality_classifier.scored(odd, model).collect()}) == 1
    empty = quality_classifier.train(docs.limit(0), labels.limit(0), ~out)
    assert quality_classifier.scored(docs.limit(2), empty).first().score == 0.5


def test_chat_round_trip(spark):
    texts = ["", "<|im_end|>\n", "<|im_end|><|im_start|>assistant ok", "a<\\|b<\\\\|c", "<|", "<\\", "|", "\\n\\", "<|im_start|>user\nx<|im_end|>\n", "<\\\\\\|\n", "$1\\$1", None]
    rows = [(i, j, r, t) for i, t in enumerate(texts) for j, r in enumerate(["user", "assistant", "we\nird<|", "b\\n+% x", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(df)
    assert made.where("NOT (turns <=> recovered)").count() == 0 and made.where(F.col("formatted").isNull()).count() == 0
    r = chat.digests(made.where("conv_id = 2")).first()
    for row in made.collect():  # the mask is read from the rendered text alone
        said = [x.start for x in row.loss_spans]
        assert said == sorted(said) and len(said) == sum(t.role == "assistant" for t in row.turns)
        assert all(row.formatted[x.start - 11 : x.start] == ">assistant\n" and row.formatted[x.start + x.length :].startswith("<|im_end|>") for x in row.loss_spans)
    masked = made.select("conv_id", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()
    assert {m.conv_id: m.learnt for m in masked} == {i: [t or ""] for i, t in enumerate(texts)}
    assert r.loss_chars == len(texts[2]) and r.loss_sha256 == hashlib.sha256(texts[2].encode()).hexdigest() and r.escaped
    assert chat.formatted(df.where("false")).count() == 0


def leaks_by_force(docs, items):
    found = set()
    for d, t in docs:
        for i, x in items:
            a, b = ([w.strip('.,"').lower() for w in s.split()] for s in (t or "", x))
            if len(b) >= 8 and any(a[k : k + len(b)] == b for k in range(len(a))):
                found.add((d, i))
    return found


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(k, sentence(25)) for k in range(6)] + [(6, "yesterday Anna bought 12 apples and gave 5 apples to her friend Bob who then had 17 apples")]
    docs = [(k, sentence(60)) for k in range(20)] + [(20 + k, f"{sentence(15)} {items[k][1]} {sentence(9)}") for k in range(6)]
    docs += [(30, sentence(9) + " " + items[6][1].replace("Anna", "Carla").replace("12", "30").replace("17", "44").replace("5", "9"))]
    docs += [(31, sentence(9) + " yesterday Anna bought 12 apples and gave 5 apples to her friend Anna who then had 12 apples"), (32, None), (33, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "x"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()}
    assert got == leaks_by_force(docs, items[:6]) | {(30, 6)}
    assert decontamination.clean(d, b).count() == len(docs) - 7
    assert decontamination.verdicts(d, b.limit(0)).where("NOT kept").count() == 0
    assert decontamination.verdicts(d.limit(0), b).count() == 0


def test_decontamination_finds_short_and_number_heavy_copies(spark):
    items = [(1, "which river flows through the old town"), (2, "How tall is Mount Everest today?"), (3, "12 34 56 78 90 11 22 33 44 55 66 77"), (4, "add Anna 5 Bob 7 Carla 9 Dora 11 Emil 13 Frida 15"), (5, "name Rome Paris Oslo")]
    docs = [(k, f"some words stand before this. {t} and many other words come after it here") for k, t in items]
    docs += [(20, "they asked How tall is Mount Everest today? and went on to other things"), (21, "12 34 56 78 91 11 22 34 44 55 67 77 and many other words come after it here"), (22, ""), (23, "which river flows through the new town and many other words")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()}
    assert got == {(k, k) for k, _ in items} | {(20, 2)}


def test_decontamination_of_a_first_row_without_words(spark):
    d = spark.createDataFrame([(1, ""), (2, "a b c")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(1, "one line of words that is long enough here")], "item_id long, text string")
    assert decontamination.verdicts(d, b).where("kept").count() == 2


def test_bitmap_holds_all_hashes(spark):
    rng = random.Random(3)
    hashes = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [0, -1, decontamination.BITMAP_BITS - 1]
    bits = decontamination._bitmap(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    at = [h % decontamination.BITMAP_BITS for h in hashes]
    assert all(bits[a >> 3] >> (a & 7) & 1 for a in at) and sum(map(int.bit_count, bits)) == len(set(at))


def test_decontamination_allows_for_words_put_in_and_longer_names(spark):
    item = "The farmer Anna sold 12 baskets of ripe apples at the market while her brother Tom carried 7 boxes of pears to the old mill before the rain began to fall on the hills"
    told = item.replace("Anna", "Anna Maria").replace("12", "twenty five").replace("Tom", "Peter")
    longer = item.replace("while her", "while also her")
    other = "Nobody sold baskets of anything today because the whole market was closed and the boxes of pears had gone to another mill far beyond the hills"
    rows = [(1, ""), (2, f"Well then {told} and more was said"), (3, f"{longer} indeed"), (4, other), (5, None), (6, "word " * 200_000 + item), (7, f"so {item}"), (7, f"so {item}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, leaked string").coalesce(1)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [1, 4, 5]
    assert {r.doc_id: r.n_items for r in decontamination.verdicts(docs, bench).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1}
    assert decontamination.clean(docs.limit(0), bench).count() == 0 and decontamination.clean(docs, bench.limit(0)).count() == 8


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.choice((1, 2, 2, 3)))) + rng.choice(("", "", "", "", ",", ".")) for _ in range(n))


def test_compression_bands_reject_what_the_base_rules_pass(spark):
    rng = random.Random(2)
    code = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    coded = " ".join(code(60) for _ in range(120))
    said_again = "\n".join(" ".join(w if k % 2 else f"{w}{i}" for k, w in enumerate(prose(random.Random(7), 40).split())) for i in range(60))
    half = prose(rng, 3000) + " " + " ".join(code(76) for _ in range(90))
    good = [prose(rng, n) for n in (60, 200, 1500, 12_000, 150_000)]
    rows = [(i, t, "mine") for i, t in enumerate([coded, said_again, half, *good])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality_rules.measured(docs).collect()}
    assert not any(got[i].base_failed for i in (0, 2, 3, 4, 5, 6, 7))
    assert [got[i].kept for i in range(8)] == [False, False, False, True, True, True, True, True]
    assert sorted((r.doc_id, r.kept) for r in quality_rules.keep_good(docs).collect()) == [(i, "mine") for i in range(3, 8)]


def test_packing_carries_all_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)
    rows = [(i, 0, 0, 60 if i < 300 else 40, i) for i in range(600)] + [(600 + i, 0, 0, 55, i) for i in range(100)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartitionByRange(12, "doc_id")
    got = packing.pack(found, 100).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    assert len({r.sequence_id for r in got}) <= 450  # 400 at best, in tasks of 40 items


def test_penalty_is_chosen_from_rows_to_fit_on_only():
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.5, 1, (200, quality_classifier.N_FEATURES)), rng.normal(0, 1, (300, quality_classifier.N_FEATURES))
    penalty = quality_classifier.chosen_penalty(p, u, 0.4)
    assert penalty in quality_classifier.PENALTIES
    model = quality_classifier.fit(p, u, 0.4, penalty)
    z = model.scores(p), model.scores(u)
    by_hand = -0.4 * np.log(z[0]).mean() + max(0, -np.log(1 - z[1]).mean() + 0.4 * np.log(1 - z[0]).mean())
    assert abs(quality_classifier.risk(model, p, u) - by_hand) < 1e-9 and z[0].mean() > z[1].mean()


def test_near_duplicates_keep_all_texts_of_one_id(spark):
    rows = [(1, "one two three four five six seven", "x"), (1, "quite another text with other words in it", "x"), (1, "quite another text with other words in it", "x"), (2, "one two three four five six seven", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert sorted(r.text[:3] for r in near_duplicates.deduplicated(docs).collect()) == ["one", "qui"]


def test_line_dedup_of_wide_buckets(spark, monkeypatch):
    """Lines made from one by many changes: most are near, few are similar enough; blocks are tiny."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 7)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    corpus = []
    for i in range(160):
        mine = list(words)
        for k in rng.sample(range(60), rng.randrange(2, 9)):
            mine[k] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
        corpus.append((i, " ".join(mine)))
    rows = {(r.doc_id, r.line_no) for r in line_dedup.removals(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert rows == lines_by_force(corpus)


def test_line_dedup_is_native(spark, monkeypatch):
    plans, write = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), write(df, name))[1])
    docs = spark.createDataFrame([(1, "some line here\nanother one"), (2, "some line here.")], "doc_id long, text string")
    out = line_dedup.without_repeats(docs)
    plans.append(out._jdf.queryExecution().toString())
    assert {r.doc_id: r.text for r in out.collect()} == {1: "some line here\nanother one", 2: ""}
    assert len(plans) > 5 and not [p for p in plans if "MapIn" in p or "Python" in p or "Pandas" in p]


def test_line_dedup_signatures_have_high_recall(spark):
    """Pairs that are just similar enough share a band, also long lines that repeat themselves."""
    rng = random.Random(9)
    rows = []
    for n in (8, 14, 30, 60, 90, 200, 700):
        for _ in range(60):
            a = "".join(chr(97 + rng.randrange(26)) for _ in range(n))
            b = a
            while len(line_dedup.shingle_set(a) & (s := line_dedup.shingle_set(c := b[: (i := rng.randrange(n))] + "X" + b[i + 1 :]))) >= 0.8 * len(line_dedup.shingle_set(a) | s):
                b = c
            rows += [(len(rows), a), (len(rows) + 1, b)]
    rows += [(len(rows), "long words " * 700), (len(rows) + 1, "long words " * 90)]
    keys = {r.id: set(r["keys"]) for r in line_dedup.signatures(spark.createDataFrame(rows, "id long, line string")).collect()}
    met = [bool(keys[i] & keys[i + 1]) for i in range(0, len(rows), 2)]
    assert met[-1] and sum(met) > 0.97 * len(met)


def test_line_dedup_of_short_lines_with_one_shingle_more_has_full_recall(spark):
    rng = random.Random(3)
    pairs = [(a, a + rng.choice("abcdefghij")) for n in (8, 9, 10, 11) for a in ("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n)) for _ in range(60))]
    rows = [(i, x) for i, x in enumerate(x for pair in pairs for x in pair)]
    keys = {r.id: set(r["keys"]) for r in line_dedup.signatures(spark.createDataFrame(rows, "id long, line string")).collect()}
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(len(pairs)))


def test_line_dedup_verifies_few_pairs_of_lines_that_are_only_near(spark, monkeypatch):
    """Lines made from one by many changes, none similar enough: they share buckets, but their bitmaps show them apart."""
    pairs, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda met, lines: (pairs.append(met.count()), verified(met, lines))[1])
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    corpus = [(0, " ".join(words))]
    for i in range(1, 90):
        mine = list(words)
        for k in rng.sample(range(60), 7):
            mine[k] = "".join(rng.choice("qrstuvwxyz") for _ in range(6))
        corpus.append((i, " ".join(mine)))
    rows = {(r.doc_id, r.line_no) for r in line_dedup.removals(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert rows == lines_by_force(corpus)
    assert pairs[1] < 10
