"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names become typed placeholders, other words lose
case and outer punctuation. Words that make up one number or name are one token, and a capital at a
sentence's start is a name's if the word is a name elsewhere in the text. Windows of WINDOW tokens of the benchmark items are hashed; the windows
of the documents first pass a bitmap of fixed size (BITMAP_BITS) of the benchmark's hashes, so only
windows that may match are shuffled, and are then joined with the benchmark's windows by hash.

A match keeps the values in its slots. Matches of one item in one document, at one distance, are
one alignment; so are those at a chain of distances at most SHIFT apart, as a word may be put in or
left out, or a name have more words. An alignment counts if it covers at least COVER percent of the item's windows and
its slots are consistent: each value of the item always became the same value in the document, and
different values stayed different. So an exact copy counts, and a copy with other numbers and names
put in consistently does; a text that only has the same phrases doesn't.

Items that every text matches alike, as they are one template with one pattern of equal values (and the same words
where windows are taken with them), are one class and are matched once, by the item with the least id. Of a class's windows those
that the fewest classes have come first: as at least COVER percent have to match, one of the first ones does, so only
documents with one of these meet the class. A phrase that very many items and documents share brings nothing together.

A window of fewer than MIN_LITERAL words other than slots is hashed with the values in its slots, so
it only matches the same words. It counts where all of an item's windows are taken together; windows
with more literals are also judged by themselves.

Results for odd inputs: null texts count as empty and match nothing; an item of fewer than WINDOW
words is one window, in either form, and documents are searched for windows of its length too; one
of fewer than MIN_LITERAL words is ignored, as it says too little; repeated rows are judged by themselves, but rows with one doc_id share the verdict; a
null doc_id or item_id is not judged; empty tables give no matches. Further columns aren't carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.shared import BLANKS, forget, small_batches, text_or_empty, written

WINDOW = 8
#: Literal tokens a window needs.
MIN_LITERAL = 4
COVER = 50
#: Words by which the distances of neighbours in an alignment may differ, as words come in or go.
SHIFT = 4
BITMAP_BITS = 1 << 25
#: Windows of the benchmark that are sent to all tasks; more are joined by a shuffle, in SALTS parts.
FEW, SALTS = 50_000, 16
CACHED = 300_000
#: Units of measure, fixed values.
UNITS = frozenset("kilometer meter zentimeter meile meilen gramm kilo kilogramm pfund tonnen stunde stunden minuten sekunde sekunden tag tage woche wochen monat monate jahr jahre prozent kilomètres mètres heure heures jour jours semaine semaines mois ans kilómetros metros hora horas minutos segundos día días semanas meses años km m cm mm mi mile miles ft feet inch inches yd kg g mg lb lbs oz ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh % percent $ usd eur gbp dollar dollars cent cents euro euros pound pounds °c °f degrees w kw kwh j kj cal kcal v a hz khz mhz ghz b kb mb gb tb".split())
#: Words for numbers in English, German, French and Spanish, fixed values; words that are articles or others in one of these are left out.
NUMBER_WORDS = frozenset("zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn zwanzig dreißig vierzig fünfzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante cent mille dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta cien ciento mil one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\d?(?:[a-z%°]{0,3})?")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%") + "“”‘’«»¿¡…–—"
_MIX = np.uint64(0x9E3779B97F4A7C15)
LITERAL, NUMBER, UNIT, NAME = range(4)
_SOLID = ~np.isin(np.arange(256), list(BLANKS))
_EDGE_BYTES = np.isin(np.arange(256), list(_EDGE.encode("ascii", "ignore"))) | ~_SOLID
_QUOTE_BYTES = np.isin(np.arange(256), list(b"\"')")) | ~_SOLID
_STOP_BYTES = np.isin(np.arange(256), list(b".!?:"))
_SLOW_BYTES = np.isin(np.arange(256), list(b"0123456789$%ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def token(word: str, begins: bool) -> tuple[int, str]:
    """(kind, bare word) of a word; begins: it begins a sentence, where a capital tells nothing."""
    bare = word.strip(_EDGE)
    low = bare.lower()
    if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
        return NUMBER, low
    if low in UNITS and len(low) > 1 or low in ("$", "%"):
        return UNIT, low
    if not begins and len(bare) > 1 and bare[0].isupper() and not bare.isupper():
        return NAME, low
    return LITERAL, low


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    h = (end - start).astype(np.uint64) * _MIX
    room = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(room, (len(raw) + 1, 8), (1, 1))
    live = np.nonzero(end > start)[0]
    at = start[live]
    while len(live):  # eight bytes of each run that has some left
        left = end[live] - at
        part = np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _LOW_BYTES[np.minimum(left, 8)]
        g = (h[live] ^ part) * _MIX
        h[live] = g ^ (g >> np.uint64(29))
        more = left > 8
        live, at = live[more], at[more] + 8
    return h


def hashes_of(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8", "replace") for w in words]
    ends = np.cumsum([0, *map(len, data)])
    return run_hashes(np.frombuffer(b"".join(data), np.uint8), ends[:-1], ends[1:])


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run has a flagged place."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return sums[end] > sums[start]


def _trimmed(keep: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs from their first to after their last flagged place; empty if they have none."""
    places = np.append(np.nonzero(keep)[0], len(keep))
    first, last = np.searchsorted(places, start), np.searchsorted(places, end) - 1
    some = first <= last
    return np.where(some, places[first], start), np.where(some, places[np.maximum(last, 0)] + 1, start)


_PLACEHOLDERS = np.append(np.uint64(0), hashes_of(["<number>", "<unit>", "<name>"]))
_WORDS_OF = {w: k for k, words in ((NUMBER, NUMBER_WORDS), (UNIT, UNITS)) for w in words if len(w) > 1}
_CODES = hashes_of(list(_WORDS_OF))
_CODE_KINDS = np.array(list(_WORDS_OF.values()), np.int8)[np.argsort(_CODES)]
_CODES.sort()


class Tokens:
    """Template tokens of words. Words in small letters are judged as bytes, all at a time; those with capitals, digits or
    rarer characters one by one, with a bounded table of known ones."""

    def __init__(self):
        self._known: dict[int, tuple] = {}

    def of(self, text: str) -> tuple:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str]) -> list[tuple]:
        """(words, hashes, kinds, plain, tokens) of each text: its words, template hashes, kinds and hashes of the bare words;
        tokens: the first word of each template token, as words of one name or number are one token."""
        raws = [t.encode("utf-8", "replace") for t in texts]
        raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        edge = np.diff(np.concatenate([[0], _SOLID[raw].view(np.int8), [0]]))
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        n, row = len(start), np.arange(len(start))
        plain = run_hashes(raw, *_trimmed(~_EDGE_BYTES[raw], start, end))
        at = np.minimum(np.searchsorted(_CODES, plain), len(_CODES) - 1)
        kinds = np.repeat(np.where(_CODES[at] == plain, _CODE_KINDS[at], LITERAL).astype(np.int8)[:, None], 2, 1)
        _, after = _trimmed(~_QUOTE_BYTES[raw], start, end)
        ends = (after > start) & _STOP_BYTES[raw[np.maximum(after - 1, 0)]]
        rare = raw >= 128
        rare[:-1] &= ~((raw[:-1] == 0xC3) & (raw[1:] >= 0x9F))
        rare[1:] &= ~((raw[:-1] == 0xC3) & (raw[1:] >= 0x9F))
        slow = np.nonzero(_within(rare | _SLOW_BYTES[raw], start, end))[0]
        if len(slow):
            codes, where, inverse = np.unique(run_hashes(raw, start[slow], end[slow]), return_index=True, return_inverse=True)
            found = self._judged(codes.tolist(), raw, start[slow[where]].tolist(), end[slow[where]].tolist())
            for have, values in zip((kinds, plain, ends), zip(*found, strict=True), strict=True):
                have[slow] = np.array(values, have.dtype)[inverse]
        bounds = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        begins = np.append(True, ends[:-1])[:n]
        begins[bounds[:-1][bounds[:-1] < n]] = True
        kind = kinds[row, begins.astype(np.int64)]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = kind[a:b].copy()
            names = plain[a:b][own == NAME]
            if len(names):  # at the start of a sentence a capital is a name's if the word is a name elsewhere
                own[(kinds[a:b, 0] == NAME) & np.isin(plain[a:b], names)] = NAME
            hashes = np.where(own == LITERAL, plain[a:b], _PLACEHOLDERS[own])
            again = np.append(False, (own[1:] == own[:-1]) & ((own[1:] == NAME) | (own[1:] == NUMBER)) & ~ends[a : max(a, b - 1)])[: b - a]
            out.append((_Words(raw, start[a:b], end[a:b]), hashes, own, plain[a:b], np.nonzero(~again)[0]))
        return out

    def _judged(self, codes: list[int], raw: np.ndarray, start: list[int], end: list[int]) -> list[tuple]:
        """(kinds, plain, ends) of words, from the table or looked at now."""
        if len(self._known) > CACHED:
            self._known.clear()
        fresh = [k for k, c in enumerate(codes) if c not in self._known]
        words = [raw[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in fresh]
        judged = [(token(w, False), token(w, True)) for w in words]
        for k, w, (within, first), h in zip(fresh, words, judged, hashes_of([j[0][1] for j in judged]), strict=True):
            self._known[codes[k]] = ((within[0], first[0]), h, w.rstrip("\"')”’»")[-1:] in (".", "!", "?", ":"))
        return [self._known[c] for c in codes]


class _Words:
    """The words of a text by number, decoded when they are asked for."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        self._raw, self._start, self._end = raw, start, end

    def __len__(self) -> int:
        return len(self._start)

    def value(self, a: int, b: int) -> str:
        """Words a to b - 1 without case and outer punctuation."""
        words = (self._raw[self._start[k] : self._end[k]].tobytes().decode("utf-8", "replace") for k in range(a, b))
        return " ".join(w.strip(_EDGE).lower() for w in words)


def window_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the windows of `size` tokens."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    h = np.full(n - size + 1, seed, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + hashes[k : n - size + 1 + k]
    return h ^ (h >> np.uint64(32))


def literals(kinds: np.ndarray, size: int) -> np.ndarray:
    """Literal tokens of each window."""
    sums = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    return sums[size:] - sums[:-size]


_WINDOWS = "doc_id long, at int, size int, exact boolean, hash long, slots array<struct<kind:int,value:string>>"
_SLOTS = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())]))


def template_windows(texts: DataFrame, bitmap=None, forms: list[tuple[int, bool]] | None = None) -> DataFrame:
    """Windows of texts (doc_id, text): those of benchmark items; or, with a broadcast bitmap, those of the given forms (size, exact) that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            rows = []
            found_in = tokens.of_all(batch.column(1).to_pylist())
            for key, (words, hashes, kinds, plain, firsts) in zip(batch.column(0).to_pylist(), found_in, strict=True):
                short, few = min(WINDOW, len(words)), min(WINDOW, len(firsts))
                own = [(few, False)] * (few >= MIN_LITERAL) + [(short, True)] * (short >= MIN_LITERAL)
                for size, exact in own if bits is None else forms:
                    units = np.arange(len(words)) if exact else firsts
                    if len(units) < size:
                        continue
                    found = window_hashes((plain if exact else hashes)[units], size, size + WINDOW + 1 if exact else size)
                    if not exact:
                        wanted = literals(kinds[units], size) >= MIN_LITERAL
                    elif bits is None and size == WINDOW:
                        wanted = literals(kinds, size) < MIN_LITERAL
                    else:
                        wanted = np.ones(len(found), bool)
                    if bits is not None:
                        bit = (found % np.uint64(BITMAP_BITS)).astype(np.int64)
                        wanted &= bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
                    places = np.nonzero(wanted)[0]
                    until = np.append(units, len(words))
                    for at, h in zip(places.tolist(), found[places].view(np.int64).tolist(), strict=True):
                        slots = [{"kind": int(kinds[units[i]]), "value": words.value(until[i], until[i + 1])} for i in range(at, at + size) if kinds[units[i]]]
                        rows.append((key, int(units[at]), size, exact, h, slots))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kept = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), _SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kept, strict=True)], names=["doc_id", "at", "size", "exact", "hash", "slots"])

    return texts.mapInArrow(run, _WINDOWS)


def _bitmap(windows: DataFrame) -> bytes:
    """BITMAP_BITS bits, one set for each hash; built by the executors in pieces of 4 KB."""
    # The modulus is a power of two, so the hash's sign doesn't matter; the functions count bits from 1.
    unsigned = F.pmod(F.col("hash"), F.lit(BITMAP_BITS)) + 1
    pieces = windows.groupBy(F.bitmap_bucket_number(unsigned).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(unsigned)).alias("bits"))
    out = bytearray(BITMAP_BITS // 8 + 8192)
    for row in pieces.collect():  # at most BITMAP_BITS / 32768 rows
        at = (row.piece - 1) * 4096
        out[at : at + 4096] = row.bits
    return bytes(out)


def _alignments(hits: DataFrame) -> DataFrame:
    """hits with `alignment`: each once with the matches at its own distance, and once with those at distances near it, where there are any."""
    order = Window.partitionBy("doc_id", "item_id").orderBy("distance")
    distances = hits.select("doc_id", "item_id", "distance").distinct()
    starts = distances.withColumn("new", F.coalesce((F.col("distance") - F.lag("distance").over(order) > SHIFT).cast("int"), F.lit(0)))
    chained = starts.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = chained.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "item_id", "chain"))).where("n > 1")
    own = hits.withColumn("alignment", F.concat_ws(":", F.lit("at"), "distance"))
    wide = hits.join(near.select("doc_id", "item_id", "distance", "chain"), ["doc_id", "item_id", "distance"])
    return own.unionByName(wide.withColumn("alignment", F.concat_ws(":", F.lit("chain"), "chain")).drop("chain"))


def _class_keys(items: DataFrame) -> DataFrame:
    """(item_id, key) of rows of items: a digest of all that decides what a text's windows make of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            keys = []
            for words, hashes, kinds, plain, firsts in tokens.of_all(batch.column(1).to_pylist()):
                until, seen = np.append(firsts, len(words)), {}
                pattern = [seen.setdefault((int(kinds[a]), words.value(a, b)), len(seen)) for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True) if kinds[a]]
                short = len(words) < WINDOW
                exact = short or bool((literals(kinds, WINDOW) < MIN_LITERAL).any())
                digest = hashlib.sha256(hashes[firsts].tobytes() + b"|" + np.array(pattern, np.int64).tobytes())
                digest.update(b"|" + (plain.tobytes() if exact else b""))
                keys.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["item_id", "key"])

    return items.mapInArrow(run, "item_id long, key string")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id) of a benchmark: class_id is the least item_id of the class."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    keys = _class_keys(items).groupBy("item_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "|"), 256).alias("key"))  # a row, where ids don't repeat
    firsts = keys.groupBy("key").agg(F.min("item_id").alias("class_id"))
    return keys.join(firsts, "key").select("item_id", "class_id")


def _first_windows(asked: DataFrame) -> DataFrame:
    """(item_id, hash, size, exact) of the windows of which a leak must have one: so many of the rarest that the others are fewer than COVER percent."""
    spread = asked.groupBy("hash", "size", "exact").agg(F.countDistinct("item_id").alias("spread"))
    rows = asked.join(spread, ["hash", "size", "exact"])
    out = []
    for some in (rows, rows.where("NOT exact")):
        places = some.groupBy("item_id", "item_at").agg(F.max("spread").alias("spread"))
        item = Window.partitionBy("item_id")  # an item's windows are as many as its words at most
        ranked = places.withColumn("rank", F.row_number().over(item.orderBy("spread", "item_at"))).withColumn("n", F.count("*").over(item))
        first = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * COVER / 100) + 1).select("item_id", "item_at")
        out.append(some.join(first, ["item_id", "item_at"]).select("item_id", "hash", "size", "exact"))
    return out[0].unionByName(out[1]).distinct()


def _met(many: DataFrame, few: DataFrame, on: list[str], n: int) -> DataFrame:
    """many with the rows of few: sent to all tasks if there are few (n, of about 200 bytes), else joined in SALTS parts, as one key may have very many rows."""
    if n <= FEW:
        return many.join(F.broadcast(few), on)
    parts = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parts, [*on, "_part"]).drop("_part")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id (the least of its class), n_items (of the class), n_windows (of the item), n_matched, n_slots and n_changed (of the best alignment) for each leak found."""
    spark = docs.sparkSession
    small_batches(spark)
    members = written(item_classes(benchmark), "classes")
    classes = members.groupBy(F.col("class_id").alias("item_id")).agg(F.count("*").alias("n_items"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).join(classes.select("item_id"), "item_id").select(F.col("item_id").alias("doc_id"), "text")
    asked = template_windows(items).select(F.col("doc_id").alias("item_id"), F.col("at").alias("item_at"), "size", "exact", "hash", F.col("slots").alias("item_slots"))
    asked = written(asked, "benchmark")
    n = asked.count()
    sent = spark.sparkContext.broadcast(_bitmap(asked))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    forms = [(r.size, r.exact) for r in asked.select("size", "exact").distinct().collect()]  # at most two a length
    window = ["hash", "size", "exact"]
    found = written(template_windows(texts, sent, forms), "windows")
    pairs_of = _met(found.select("doc_id", *window), _first_windows(asked), window, n).select("doc_id", "item_id").distinct()
    hits = _met(pairs_of, asked, ["item_id"], n).join(found, ["doc_id", *window])
    same = F.transform("item_slots", lambda a: F.struct(a["kind"].alias("kind"), a["value"].alias("asked"), a["value"].alias("given")))
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("asked"), b["value"].alias("given")))
    aligned = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("distance"), "item_at", "exact", F.when(F.col("exact"), same).otherwise(pairs).alias("pairs"))
    aligned = _alignments(written(aligned, "hits"))
    forget(found)
    per = ["doc_id", "item_id", "alignment"]
    template = F.when(~F.col("exact"), F.col("item_at"))
    matched = aligned.groupBy(*per).agg(F.countDistinct("item_at").alias("n_matched"), F.countDistinct(template).alias("n_alike"))
    slots = aligned.select(*per, F.explode("pairs").alias("p")).select(*per, "p.*").distinct()
    consistent = slots.groupBy(*per).agg(
        F.countDistinct("kind", "asked").alias("n_asked"), F.countDistinct("kind", "given").alias("n_given"), F.count("*").alias("n_slots"), F.count_if(F.col("asked") != F.col("given")).alias("n_changed")
    )
    sizes = asked.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(template).alias("n_templates")).join(classes, "item_id")
    judged = matched.join(consistent, per, "left").join(sizes, "item_id")
    fine = F.coalesce((F.col("n_asked") == F.col("n_slots")) & (F.col("n_given") == F.col("n_slots")), F.lit(True))
    alike = (F.col("n_alike") > 0) & (100 * F.col("n_alike") >= COVER * F.col("n_templates"))
    leaks = judged.where(fine & (alike | (100 * F.col("n_matched") >= COVER * F.col("n_windows"))))
    best = F.max(F.struct("n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))).alias("best")
    return leaks.groupBy("doc_id", "item_id").agg(F.first("n_items").alias("n_items"), F.first("n_windows").alias("n_windows"), best).select("doc_id", "item_id", "n_items", "n_windows", "best.*")


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items (leaked), item_ids (sorted: the least of each class of items; item_classes() has the others) and kept per row of docs."""
    leaks = contaminated(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("n_items").alias("n_items"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.col("item_ids").isNull().alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with the columns they came with."""
    leaked = contaminated(docs, benchmark).select(F.col("doc_id").alias("_lexloom_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"].cast("long") == F.col("_lexloom_leaked"), "left_anti")
