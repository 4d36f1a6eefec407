"""Raw records against their schema: all errors of a record with their paths, before anything is typed.

A record is one JSON text. It is read as a variant, so extra keys and wrong types are still there to be
seen, and every rule adds (path, problem) to the record's errors; nothing stops at the first. Only a
record all of whose errors are unknown labels is rejected for its labels; any other error makes its
schema invalid. All of this is built-in functions over the variant.

Numbers may be written as numbers, as texts that are numbers, or as booleans; texts are trimmed and
no other type is taken for one. A JSON text with something after it, or with a key twice in one object (by Spark's
setting for variants), is not a record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "array<struct<path: string, problem: string>>"
SLOTS = "array<struct<type: string, value: string>>"
#: The kinds of requests, the styles, and the forms of ids and prompt versions.
RECIPES = ("paraphrase", "slot_substitution", "noise_codeswitch", "hard_negative")
STYLES = ("massive_like", "tw_colloquial")
SAMPLE_ID = "^syn_[0-9a-f]{20}$"
PROMPT_VERSION = r"^[a-z_]+\.v[1-9][0-9]*$"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MISSING, EXTRA, UNKNOWN = "missing", "extra key", "unknown label"


@dataclass(frozen=True)
class At:
    """A place in a variant, read from the whole of it: a part taken out of it as a variant is a copy with all that is in it."""

    whole: Column
    place: str = "$"

    def field(self, name: str) -> At:
        return At(self.whole, f"{self.place}.{name}")

    def get(self, kind: str = "variant") -> Column:
        return F.try_variant_get(self.whole, self.place, kind)

    def keys(self) -> Column:
        """The keys of an object, else null."""
        return F.map_keys(self.get("map<string,variant>"))

    def list(self) -> Column:
        """The elements of a list, else null."""
        return self.get("array<variant>")


#: A rule: (place, path) to the errors of the value there. There is a value.
Rule = Callable[[At, Column], Column]


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value and nothing else: inside brackets and inside braces it is one element. Spark's own readers stop after the first value."""
    one = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    closed = F.size(F.json_object_keys(F.concat(F.lit('{"k":'), raw, F.lit("}")))) == 1
    return F.coalesce(one & closed & F.try_parse_json(raw).isNotNull(), F.lit(False))


def _kind(v: Column) -> Column:
    """The kind of a variant that is a single value; of a list or an object its whole schema."""
    return F.schema_of_variant(v)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value bound to a name, so it is evaluated once however often then() uses it."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}")) if path is not None else F.lit(name)


def _error(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem")))


def _none() -> Column:
    return F.array().cast(ERRORS)


def _bad(wrong: Column, path: Column, problem: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), _error(path, problem)).otherwise(_none())


def _text(v: Column) -> Column:
    """The trimmed text of a variant that is a text, else null."""
    return F.when(_kind(v) == "STRING", F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", ""))


def _number(v: Column) -> Column:
    """The number a variant stands for, else null."""
    kind, text = _kind(v), F.trim(F.try_variant_get(v, "$", "string"))
    number = F.when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "double"))
    return number.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when((kind == "STRING") & text.rlike(_NUMBER), text.try_cast("double"))


def text(least: int = 0, pattern: str | None = None, among: tuple[str, ...] | None = None, known: list[str] | None = None, null: bool = False) -> Rule:
    """A text of a length, form or choice; known: labels, others are an error of their own kind."""

    def judged(t: Column, v: Column, path: Column) -> Column:
        out = F.when(t.isNull(), F.when(_kind(v) == "VOID", _none()).otherwise(_error(path, "not a text")) if null else _error(path, "not a text"))
        out = out.when(F.length(t) < least, _error(path, "too short"))
        if pattern is not None:
            out = out.when(~t.rlike(pattern), _error(path, "wrong form"))
        if among is not None:
            out = out.when(~t.isin(*among), _error(path, "none of the choices"))
        if known is not None:
            out = out.when(~t.isin(*known), _error(path, UNKNOWN))
        return out.otherwise(_none())

    return lambda at, path: _let(at.get(), lambda v: _let(_text(v), lambda t: judged(t, v, path)))


def number(low: float | None = None, high: float | None = None, above: float | None = None, whole: bool = False) -> Rule:
    def judged(n: Column, path: Column) -> Column:
        out = F.when(n.isNull(), _error(path, "not a number"))
        if whole:
            out = out.when(n != F.floor(n), _error(path, "not whole"))
        for wrong in [n < low if low is not None else None, n > high if high is not None else None, n <= above if above is not None else None]:
            if wrong is not None:
                out = out.when(wrong, _error(path, "out of range"))
        return out.otherwise(_none())

    return lambda at, path: _let(at.get(), lambda v: _let(_number(v), lambda n: judged(n, path)))


def moment(at: At, path: Column) -> Column:
    """A date and time, as text or as seconds."""
    return _let(at.get(), lambda v: _bad(_number(v).isNull() & F.try_to_timestamp(_text(v)).isNull(), path, "not a time"))


def items(of: Rule) -> Rule:
    """A list, all of whose elements keep a rule; their paths have their place."""

    def rule(at: At, path: Column) -> Column:
        each = F.transform(at.list(), lambda e, i: of(At(e), F.concat(path, F.lit("."), i.cast("string"))))
        return F.coalesce(F.flatten(each), _error(path, "not a list"))

    return rule


def values(of: Rule) -> Rule:
    """An object of any keys, all of whose values keep a rule."""

    def rule(at: At, path: Column) -> Column:
        entries = F.map_entries(at.get("map<string,variant>"))
        each = F.transform(entries, lambda e: of(At(e["value"]), F.concat(path, F.lit("."), e["key"])))
        return F.coalesce(F.flatten(each), _error(path, "not an object"))

    return rule


def either(first: Rule, second: Rule) -> Rule:
    """What keeps one of two rules; else the errors by the first that comes near: the second for lists."""

    def rule(at: At, path: Column) -> Column:
        return F.when(at.list().isNotNull(), second(at, path)).otherwise(first(at, path))

    return rule


def fields(optional: tuple[str, ...] = (), whole: Rule | None = None, **rules: Rule) -> Rule:
    """An object with these keys and no others; whole is a rule on an object without errors."""

    def judged(keys: Column, at: At, path: Column) -> Column:
        parts = []
        for name, of in rules.items():
            absent = _none() if name in optional else _error(_at(path, name), MISSING)
            parts.append(F.when(F.array_contains(keys, name), of(at.field(name), _at(path, name))).otherwise(absent))
        extra = F.array_sort(F.filter(keys, lambda k: ~k.isin(*rules)))
        beyond = F.transform(extra, lambda k: F.struct((F.concat(path, F.lit("."), k) if path is not None else k).alias("path"), F.lit(EXTRA).alias("problem")))
        found = F.concat(*parts, beyond)
        if whole is not None:
            found = _let(found, lambda f: F.when(F.size(f) == 0, whole(at, path)).otherwise(f))
        return F.when(keys.isNotNull(), found).otherwise(_error(path if path is not None else F.lit(""), "not an object"))

    return lambda at, path: _let(at.keys(), lambda keys: judged(keys, at, path))


def _pair(at: At, path: Column) -> Column:
    """A hard negative has two seeds and a pair."""
    hard = _text(at.field("recipe").get()) == "hard_negative"
    seeds, pair = at.field("seed_sample_id").list(), _text(at.field("pair_id").get())
    return F.when(hard & (F.coalesce(F.size(seeds), F.lit(-1)) != 2), _error(path, "needs two seeds")).when(hard & (F.coalesce(F.length(pair), F.lit(0)) == 0), _error(path, "needs a pair")).otherwise(_none())


def sample_rules(intents: list[str], kinds: list[str]) -> Rule:
    """The schema of a sample, with the labels that are known."""
    params = fields(temperature=number(low=0, high=2), top_p=number(above=0, high=1), seed=number(whole=True), context_length=number(above=0, whole=True))
    provenance = fields(
        ("pair_id",),
        _pair,
        recipe=text(among=RECIPES),
        model=text(1),
        model_digest=text(1),
        prompt_version=text(pattern=PROMPT_VERSION),
        seed_sample_id=either(text(), items(text())),
        gen_params=params,
        filter_score=values(number()),
        filter_stage_passed=text(null=True),
        reject_reason=text(null=True),
        generated_at=moment,
        pair_id=text(null=True),
    )
    slots = items(fields(type=text(1, known=kinds), value=text(1)))
    return fields(utt=text(1), intent=text(1, known=intents), slots=slots, id=text(pattern=SAMPLE_ID), style=text(among=STYLES), provenance=provenance)


def read(lines: DataFrame, raw: str, intents: list[str], kinds: list[str]) -> DataFrame:
    """lines with sample and expected (typed; null where they can't be), errors, and raw_reason where reading already rejects a record.

    A text that isn't one JSON object is an error with the path "" and the reason of a missing sample.
    """
    whole = lines.withColumn("_record", F.when(is_json(F.col(raw)), F.try_parse_json(F.col(raw))))
    sample = F.try_variant_get("_record", "$.sample", "variant")
    expected = F.try_variant_get("_record", "$.expected", "variant")
    parts = whole.withColumn("_sample", F.when(At(F.col("_record")).field("sample").keys().isNotNull(), sample)).withColumn("_expected", F.when(_kind(expected) != "VOID", expected))
    missing = F.when(F.col("_record").isNull(), _error(F.lit(""), "not one JSON value")).otherwise(_error(F.lit("sample"), MISSING))
    found = parts.withColumn("errors", F.when(F.col("_sample").isNull(), missing).otherwise(sample_rules(intents, kinds)(At(F.col("_sample")), None)))
    errors = F.col("errors")
    labels = F.forall(errors, lambda e: e["problem"] == UNKNOWN)
    by_intent = F.exists(errors, lambda e: e["path"] == "intent")
    reason = (
        F.when(F.col("_sample").isNull(), "F1_SCHEMA_MISSING_SAMPLE")
        .when((F.size(errors) > 0) & ~labels, "F1_SCHEMA_INVALID")
        .when((F.size(errors) > 0) & by_intent, "F2_LABEL_UNKNOWN_INTENT")
        .when(F.size(errors) > 0, "F2_LABEL_UNKNOWN_SLOT")
        .when(F.col("_expected").isNotNull() & At(F.col("_expected")).keys().isNull(), "F1_SCHEMA_INVALID_EXPECTED")
    )
    return found.withColumn("raw_reason", reason).withColumns({"sample": typed_sample(F.col("_sample"), errors), "expected": typed_expected(F.col("_expected"))}).drop("_record", "_sample", "_expected")


def typed_sample(v: Column, errors: Column) -> Column:
    """The parts of a sample that the funnel reads, of a variant without errors."""
    slots = F.transform(F.try_variant_get(v, "$.slots", "array<variant>"), lambda s: F.struct(_text(F.try_variant_get(s, "$.type", "variant")).alias("type"), _text(F.try_variant_get(s, "$.value", "variant")).alias("value")))
    part = lambda path: _text(F.try_variant_get(v, path, "variant"))
    return F.when(F.size(errors) == 0, F.struct(part("$.utt").alias("utt"), part("$.intent").alias("intent"), slots.alias("slots"), part("$.provenance.recipe").alias("recipe")))


def typed_expected(v: Column) -> Column:
    """An expectation with its slots; null slots where they are no list, and a slot of nulls where an element is no object, which nothing equals."""
    text = lambda of, path: F.try_variant_get(of, path, "string")
    listed = F.try_variant_get(v, "$.slots", "variant")
    slots = F.transform(F.try_variant_get(v, "$.slots", "array<variant>"), lambda s: F.struct(text(s, "$.type").alias("type"), text(s, "$.value").alias("value")))
    return F.when(At(v).keys().isNotNull(), F.struct(text(v, "$.intent").alias("intent"), F.when(At(listed).list().isNotNull(), slots).alias("slots")))
