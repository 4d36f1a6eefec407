"""Variants of labelled utterances that leave slot values alone, by built-in functions.

All edits are rows of one small table (method, kind, old, new, number). A slot's value is covered in a
copy of the text, so the place of an edit is where its pattern first stands in the covered copy, and
an edit can't reach a value. A source's edits are in the order of a hash; in turns over the sources
the attempts get numbers, methods taking turns, and the first N different results are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.hashing import content_id, rank_hash
from lexloom.functions.text import comparison_form, covered
from lexloom.sources.tables import kept

#: Word lists of the edits.
SYNONYMS = [("幫我", "請"), ("請", "麻煩"), ("打開", "開啟"), ("關掉", "關閉"), ("告訴我", "跟我說"), ("查詢", "查一下"), ("搜尋", "找一下"), ("播放", "放"), ("設定", "設"), ("取消", "移除"), ("目前", "現在"), ("今天", "今日")]
INSERTIONS = ["請", "麻煩", "可以幫我", "我想要", "幫我"]
SUFFIXES = ["一下", "好嗎", "謝謝", "可以嗎"]
DELETABLE = ["請", "麻煩", "幫我", "可以", "一下", "我想要"]
HOMOPHONES = {"的": "得", "得": "的", "在": "再", "再": "在", "要": "藥", "時": "十", "是": "事", "事": "是", "到": "道", "道": "到", "開": "該", "關": "觀", "音": "因", "新": "心", "星": "新"}
FILLERS = ["呃", "嗯", "那個", "就是"]
#: Neighbouring characters that are swapped are looked for at so many places.
SWAPS = 8
_TABLE = "array<struct<method:string,kind:string,old:string,new:string,number:int>>"


def edits() -> list[tuple[str, str, str, str, int]]:
    """All edits: (method, kind, old, new, number)."""
    words = [("slot_aware_eda", "lexical", a, b) for a, b in SYNONYMS] + [("slot_aware_eda", "shorter", w, "") for w in DELETABLE]
    around = [("slot_aware_eda", "front", "", f"{w}，") for w in INSERTIONS] + [("slot_aware_eda", "back", "", w) for w in SUFFIXES]
    sounds = [("character_noise", "misheard", a, b) for a, b in HOMOPHONES.items()]
    swaps = [("slot_aware_eda", "swap", "", "", k) for k in range(SWAPS)]
    return [(*e, 0) for e in words + around + sounds] + swaps


def _literal(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*map(F.lit, r)) for r in rows]).cast(_TABLE)


def _replaced(text: Column, cover: Column, old: Column, new: Column) -> Column:
    at = F.position(old, cover)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def _swapped(text: Column, cover: Column, key: Column, number: Column, seed: int) -> Column:
    """Two different neighbouring letters or digits outside of values, at a place by hash, in each other's place."""
    drawn = F.conv(F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, F.lit("swap"), number.cast("string")), 256), F.lit(8)), 16, 10).cast("long")
    at = (drawn % F.greatest(F.length(text) - 1, F.lit(1)) + 1).cast("int")
    two = F.substring(cover, at, F.lit(2))
    good = two.rlike(r"^[\p{L}\p{N}]{2}$") & (F.left(two, F.lit(1)) != F.right(two, F.lit(1)))
    return F.when(good, F.concat(F.substring(text, F.lit(1), at - 1), F.right(two, F.lit(1)), F.left(two, F.lit(1)), F.substring(text, at + 2, F.length(text))))


def _results(rows: list[tuple], seed: int) -> Column:
    """What the edits make of a row with id, utt and its cover _cover: an array of structs (method, kind, old, new, number, made), without those that do nothing."""
    utt, cover = F.col("utt"), F.col("_cover")

    def made(e: Column) -> Column:
        return (
            F.when(e["kind"] == "front", F.concat(e["new"], utt))
            .when(e["kind"] == "back", F.concat(utt, e["new"]))
            .when(e["kind"] == "swap", _swapped(utt, cover, F.col("id"), e["number"], seed))
            .otherwise(_replaced(utt, cover, e["old"], e["new"]))
        )

    every = F.transform(_literal(rows), lambda e: F.struct(*[e[c].alias(c) for c in ("method", "kind", "old", "new", "number")], F.trim(made(e)).alias("made")))
    return F.filter(every, lambda r: (r["made"] != "") & (r["made"] != utt))


def _covered(examples: DataFrame) -> DataFrame:
    """examples with their cover, without those whose values aren't all in the text."""
    return examples.withColumn("_cover", covered(F.col("utt"), F.transform("slots", lambda s: s["value"]))).where("_cover IS NOT NULL")


def candidates(examples: DataFrame, seed: int, rows: list[tuple] | None = None) -> DataFrame:
    """examples with the edit (method, kind, old, new, number) and its result `made`, for each edit that does something."""
    given = _covered(examples).select("*", F.explode(_results(rows or edits(), seed)).alias("_edit"))
    return given.select(*examples.columns, *[F.col(f"_edit.{c}").alias(f"_{c}") for c in ("method", "kind", "old", "new", "number")], F.col("_edit.made").alias("made"))


def _edit_order(seed: int, e: dict[str, Column] | Column) -> Column:
    """The order of a source's edits: that of a hash."""
    return rank_hash(seed, F.concat_ws(":", F.col("id"), e["kind"], e["old"], e["new"], e["number"].cast("string")), "edit")


def _order(seed: int) -> Column:
    return _edit_order(seed, {c: F.col(f"_{c}") for c in ("kind", "old", "new", "number")})


def _in_slice(position: Column, size: int, low: int, high: int) -> Column:
    """Whether one of the attempts low .. high - 1 is that of a position: attempt modulo size is the position."""
    if high - low >= size:
        return F.lit(True)
    a, b = low % size, high % size
    return (position >= a) & (position < b) if a < b else (position >= a) | (position < b)


def augmented(seeds: DataFrame, target: int, seed: int = 42, attempts: int | None = None) -> DataFrame:
    """Exactly `target` new examples: id, utt, intent, slots, method, source_id, variant, attempt. Fewer in reach is an error.

    seeds: pos (0 .. n - 1), id, utt, intent, slots. A source's variant v of a method is its v-th edit in the
    order of a hash; attempts go over all sources, methods taking turns. A result counts once per
    intent and comparison form, and not at all where a seed has that form.

    An attempt's number is known before its edit is made, so attempts are made in slices, from 2 * target on
    twice as many each, until there are enough: only the sources of a slice are edited, however many there are.
    """
    size = seeds.count()
    most = 2 * len(edits()) * size if attempts is None else attempts
    known = seeds.select("intent", comparison_form(F.col("utt"), exact=True).alias("form"))
    found, n, low, high = None, 0, 0, 2 * target
    while n < target and low < most:
        made = _attempts(seeds.where(_in_slice(F.col("pos"), size, low, high)), size, seed).where((F.col("attempt") >= low) & (F.col("attempt") < min(high, most)))
        new = kept(made.withColumn("form", comparison_form(F.col("made"), exact=True)))
        fresh = new.join(known.join(new.select("intent", "form").distinct(), ["intent", "form"], "left_semi").distinct(), ["intent", "form"], "left_anti")
        rows = fresh.select("intent", "form", F.struct("attempt", "made", "slots", "_method", "id", "variant").alias("m"))
        rows = rows if found is None else rows.unionByName(found)
        found = kept(rows.groupBy("intent", "form").agg(F.min("m").alias("m")))
        n, low, high = found.count(), high, 2 * high
    if n < target:
        raise ValueError(f"fewer than {target} examples in reach")
    chosen = found.select("intent", "m.*").orderBy("attempt").limit(target)
    key = content_id("aug_", F.lit(str(seed)), "_method", "id", F.col("variant").cast("string"), "made")
    return chosen.select(key.alias("id"), F.col("made").alias("utt"), "intent", "slots", F.col("_method").alias("method"), F.col("id").alias("source_id"), "variant", "attempt")


def _attempts(sources: DataFrame, size: int, seed: int) -> DataFrame:
    """All results of some sources, with variant and the number of their attempt among all `size` sources."""
    in_method = Window.partitionBy("id", "_method").orderBy(_order(seed), "_kind", "_old", "_new", "_number")
    made = candidates(sources, seed).withColumn("variant", F.row_number().over(in_method) - 1)
    turn = 2 * F.col("variant") + F.when(F.col("_method") == "character_noise", 1).otherwise(0)
    return made.withColumn("attempt", turn.cast("long") * size + F.col("pos"))


#: Kinds of probes, and the kinds of edits each takes, the first choice first.
PROBES = {"colloquial": ("front", "back"), "lexical": ("lexical",), "asr_noise": ("misheard", "swap", "filler")}


def _first_probe(name: str, known: Column, seed: int) -> tuple[Column, Column]:
    """The first result in _made of a kind that isn't known, null if there is none; and known with all results of the kind."""
    kinds = F.array(*map(F.lit, PROBES[name]))
    of_kind = F.filter("_made", lambda r: F.array_contains(kinds, r["kind"]))
    fresh = F.filter(of_kind, lambda r: ~F.array_contains(known, r["made"]))
    choice = (lambda r: F.lit(0)) if name == "colloquial" else (lambda r: F.array_position(kinds, r["kind"]))
    ranked = F.transform(fresh, lambda r: F.struct(choice(r).alias("choice"), _edit_order(seed, r).alias("order"), r["made"].alias("made")))
    return F.array_min(ranked)["made"], F.concat(known, F.transform(of_kind, lambda r: r["made"]))


def probes(examples: DataFrame, seed: int = 42, strict: bool = False) -> DataFrame:
    """One robustness variant of each kind per example, all different; strict: a kind without one is an error when it runs.

    Of a kind's results the first counts, by the choice of edits and the order of a hash; a result that several kinds make
    is that of the first kind by name. All of it is done within the example's row, so nothing is shuffled.
    """
    fillers = [("probe", "filler", "", f"{w}，", 0) for w in FILLERS]
    fronts = [("probe", "front", *e[2:]) for e in fillers]
    made = _covered(examples).withColumn("_own", _results(edits(), seed)).withColumn("_filled", F.transform(_results(fronts, seed), lambda r: r.withField("kind", F.lit("filler"))))
    everything = made.withColumn("_made", F.concat("_own", "_filled"))
    columns, known = [], F.array().cast("array<string>")
    for name in sorted(PROBES):
        first, known = _first_probe(name, known, seed)
        missing = F.raise_error(F.concat(F.lit("no probe of some kind for "), F.col("id"))).cast("string")
        columns.append(F.struct(F.lit(name).alias("probe_kind"), (F.coalesce(first, missing) if strict else first).alias("made")))
    rows = everything.select("id", "intent", "slots", F.explode(F.array(*columns)).alias("p")).select("id", "intent", "slots", "p.*").where("made IS NOT NULL")
    key = content_id("probe_", F.lit(str(seed)), "probe_kind", "id", "made")
    return rows.select(key.alias("id"), F.col("id").alias("source_test_id"), "probe_kind", F.col("made").alias("utt"), "intent", "slots", F.lit(seed).alias("seed"), F.lit(True).alias("evaluation_only"))
