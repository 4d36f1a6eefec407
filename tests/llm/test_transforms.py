"""Fill-in-middle, conversation repair and WARC archives against brute force, and on odd inputs."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import conversation_repair, fill_in_middle, queries, warc

BLANK = " \t\n\x0b\x0c\r"


# --- Fill in the middle


def cut_by_force(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab Zé視\U0001f600\n<>PSM.") for _ in range(rng.choice([0, 1, 2, 9, 60]))) for _ in range(400)]
    return [*made, None, "", "<", "<P", "a<P>b", "<M>", "x" * 300_000, "é y" * 100_000, "\n", "<S<S"]


def test_fill_in_middle(spark):
    rows = [(k, t, "kept", "mine") for k, t in enumerate(odd_texts())] + [(7, "again and again", "kept", "mine")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, row string").repartition(3)
    out = fill_in_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "a.b", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["a.b"] for r in got} == {"kept"} and {r.row for r in got} == {"mine"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_by_force(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_tables(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = fill_in_middle.fill_in_middle(spark.createDataFrame([(None, "no id here"), (None, None)], "doc_id long, text string, form string".removesuffix(", form string"))).collect()
    assert sorted(r.n for r in rows) == [0, 5]
    clash = fill_in_middle.fill_in_middle(spark.createDataFrame([(1, "ab cd", "old")], "doc_id long, text string, form string"))
    assert clash.columns.count("form") == 1 and clash.first().form != "old"


def test_matcher_takes_no_list_of_units():
    text = "ab, " * 50_000
    assert fill_in_middle.units(text) == 150_000
    assert fill_in_middle.offsets(text, 0, 150_000) == (0, len(text)) and fill_in_middle.offsets(text, 3, 3) == (4, 4)
    import tracemalloc

    tracemalloc.start()
    fill_in_middle.transformed(text, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)  # the output and its parts; a list of units takes over 50 bytes a unit


# --- Conversations


def repaired_by_force(rows):
    """Of one conversation's damaged rows in order: what op12 says, by a search over all states that keeps the repaired turns."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))

    def put_in(ways):
        ways = dict(ways)
        for source, target, role in ((0, 2, "user"), (1, 2, "user"), (3, 2, "user"), (2, 3, "assistant")):
            if source in ways:
                cost, audit, turns = ways[source]
                ways[target] = min(ways.get(target, (10**9,)), (cost + 3, audit + "I", (*turns, (role, ""))))
        return ways

    ways = put_in({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, turns) in ways.items():
            options = [(state, (cost + 4, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                fee = 3 * (fault == "truncated")
                for initial, source, target in (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3)):
                    if role[:1] == initial and state == source:
                        options.append((target, (cost + fee, audit + "K", (*turns, (role, text)))))
                options.append((3, (cost + 3 + fee, audit + "R", (*turns, ("assistant", text)))) if state == 2 else (2, (cost + 3 + fee, audit + "R", (*turns, ("user", text)))))
            for target, way in options:
                after[target] = min(after.get(target, (10**9,)), way)
        ways = put_in(after)
    cost, audit, turns = min(ways[k] for k in (0, 3) if k in ways)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in turns))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged_by_force(data):
    groups = defaultdict(list)
    for conv, turn, role, text in data:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, g in groups.items()}


def talks(rng, sizes):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uživatel"], ["Hi.", "ok", "What?", " ", "", None, "yes!\n", "no.  ", "ü."]
    return [(c or None, rng.choice([i, i, i, None, rng.randrange(n)]), rng.choice(roles), rng.choice([*texts, f"t{i}.", f"t{i}"])) for c, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("chunk", [2, 64])
def test_conversation_repair(spark, chunk, monkeypatch):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    data = talks(rng, [rng.choice([1, 2, 3, 5, 9]) for _ in range(120)] + [300])
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    out = conversation_repair.with_lost(conversation_repair.repaired(conversation_repair.damaged(table)), table)
    want = {c: repaired_by_force(g) for c, g in damaged_by_force(data).items()}
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want


def test_conversation_repair_of_long_texts_and_many_equal_rows(spark):
    data = [(1, 0, "user", "Long. " * 100_000), (1, 1, "assistant", "ok.")] + [(2, 5, "user", "Same.")] * 1000 + [(3, None, "assistant", "x")]
    table = spark.createDataFrame([(*r, "more") for r in data], "conv_id long, turn long, role string, text string, chunk string")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repaired(table).collect()}
    assert got == {c: repaired_by_force([r[1:] for r in data if r[0] == c]) for c in (1, 2, 3)}
    assert got[2][6] == "K" + "D" * 999 + "I"


def test_conversation_repair_without_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.with_lost(conversation_repair.repaired(conversation_repair.damaged(table)), table).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Hi.")], table.schema)
    assert [tuple(r) for r in conversation_repair.with_lost(conversation_repair.repaired(conversation_repair.damaged(table)), table).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", sha(""))]


# --- Archives


def archive(payloads, level=6):
    parts = []
    for k, payload in enumerate(payloads):
        text = warc.rendered(k, f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None, False, "2020-01-01T00:00:00Z")
        parts.append(warc.member(text, level))
    return parts


def foreign(payload, k):
    """A member by a writer that stores records as they are."""
    text = warc.rendered(k, None, payload, hashlib.sha1(payload).hexdigest(), None, False, "2020-01-01T00:00:00Z")
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    return pack.compress(text) + pack.flush()


class Source(io.BytesIO):
    pass


@pytest.mark.parametrize("size", [1, 3, 17, 100, 1000, 10**6])
def test_every_record_has_one_owner(size):
    rng = random.Random(size)
    nested = b"".join(archive([b"inner one", b"inner two"]))
    payloads = [rng.randbytes(rng.choice([0, 5, 300, 3000])) for _ in range(30)] + [nested, warc.MAGIC * 50, b"", rng.randbytes(400_000) if size > 100 else b"y"]
    data = b"".join(archive(payloads, level=0))
    found = [x for start in range(0, len(data), size) for x in warc.owned(Source(data), len(data), start, start + size)]
    assert [r.payload for *_, r in found] == payloads and [r.page_id for *_, r in found] == list(range(len(payloads)))


@pytest.mark.parametrize("size", [40, 300, 10**6])
def test_members_inside_records_of_other_writers_go_by_their_places(spark, tmp_path, size):
    inner = b"".join(foreign(b"inner %d" % k, 100 + k) for k in range(4))
    data = foreign(b"first", 0) + foreign(inner, 1) + foreign(b"last", 2)
    (tmp_path / "x.warc.gz").write_bytes(data)
    table = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, length long")
    got = warc.sound(warc.without_nested(warc.records(table, range_bytes=size)))
    assert [bytes(r.payload) for r in got.orderBy("place").collect()] == [b"first", inner, b"last"]


@pytest.mark.parametrize("size", [13, 200, 10**6])
def test_damage_is_told_once_and_costs_one_record(size):
    parts = archive([b"first" * 40, b"second" * 40, b"third" * 40, b"fourth" * 40])
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + bytes(broken) + parts[2] + parts[3]
    found = [x for start in range(0, len(data), size) for x in warc.owned(Source(data), len(data), start, start + size)]
    assert [r.page_id if r else None for *_, r in found] == [0, None, 2, 3]
    assert found[1][0] == len(parts[0])


def pages_by_force(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        largest = max(same, default=None)
        revisit = len(payload) >= 1000 and largest is not None and page != largest
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [0, 1000])
def test_pages_make_the_round_trip(spark, few, monkeypatch):
    monkeypatch.setattr(warc, "FEW_GROUPS", few)
    same, umlauts = "same page " * 200, "ü" * 500
    rows = [(k, f"http://x/{k} y\r\nz", same if k % 3 == 0 else f"page {k} " * (k % 7 * 40)) for k in range(200)]
    rows += [(300, None, umlauts), (301, "u", umlauts), (302, "u", "s" * 999), (303, "u", "s" * 999), (None, "u", same), (199, "u", umlauts), (301, "u", umlauts), (400, "", None), (401, "é", "")]
    table = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, path string").repartition(4)
    out = warc.round_trip(spark, table)
    got = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == pages_by_force(rows)
    urls = {r.page_id: r.url for r in out.collect()}
    assert urls[0] == "http://x/0%20y%0D%0Az" and urls[300] is None and urls[401] == "é"


def test_archives_are_read_in_any_ranges_by_any_reader(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"text {k} " * (k * 11 % 700)) for k in range(150)]
    archives = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    assert archives.agg(F.sum("records")).first()[0] == 150
    for size in (100, 5000, 1 << 30):
        assert {r.page_id: bytes(r.payload).decode() for r in warc.sound(warc.records(archives, range_bytes=size)).collect()} == {k: h for k, _, h in rows}
    texts = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir()]  # members in a row are one gzip file
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type: response\r\n") for t in texts) == 150


def test_damaged_archive_is_an_error_of_the_job(spark, tmp_path):
    data = b"".join(archive([b"a" * 99, b"b" * 99]))
    (tmp_path / "x.warc.gz").write_bytes(data[:-4] + b"\0\0\0\0")
    table = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, length long")
    assert sorted(r.error is None for r in warc.records(table).collect()) == [False, True]
    with pytest.raises(Exception, match="damaged member"):
        warc.sound(warc.records(table)).collect()


def test_no_pages_make_no_archives(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sql_of_the_new_queries(spark):
    import duckdb

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "conversations", "pages"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("op11_fill_in_middle", "op12_conversation_repair", "op13_warc_round_trip"):
        got = queries.queries()[name](spark, folder)
        columns = sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str), name
