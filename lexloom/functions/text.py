"""Text columns: comparison form, script shares, annotated utterances, containment."""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Phrases that mark a text as written for another region.
BANNED_TERMS = ("視頻", "軟件", "硬件", "信息", "網絡", "出租車", "公交", "地鐵", "文件夾", "默認", "打印")
#: Kana, Hangul and Cyrillic blocks, a fixed value.
UNEXPECTED_SCRIPT = r"[\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]"
HAN = r"[\x{3400}-\x{9fff}]"
#: One annotation, "[type : value]", a fixed format.
ANNOTATION = r"\[\s*([^\[\]:]+?)\s*:\s*(.*?)\s*\]"
#: Blocks of Han characters that simplified forms are looked for in, as code points.
HAN_BLOCKS = ((0x3400, 0x4DC0), (0x4E00, 0xA000))
#: Stands in a text where something was found and taken.
COVER = "\0"


@functools.lru_cache(maxsize=1)
def simplified() -> dict[str, str]:
    """Every simplified character with its traditional form, one to one, as ICU has them; ICU is on Spark's class path."""
    icu = SparkSession.active()._jvm.com.ibm.icu.text.Transliterator.getInstance("Simplified-Traditional")
    characters = [chr(c) for first, end in HAN_BLOCKS for c in range(first, end)]
    forms = icu.transliterate("\n".join(characters)).split("\n")
    return {c: form for c, form in zip(characters, forms, strict=True) if c != form and len(form) == 1}


def _icu(text: Column, kind: str, method: str) -> Column:
    """A static method of ICU that takes a text and true, within the JVM; null for null."""
    return F.when(text.isNotNull(), F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True)))


def compatible(text: Column) -> Column:
    """Full-width and other compatibility forms folded (NFKC)."""
    return _icu(text, "text.Normalizer", "compose")


def case_folded(text: Column) -> Column:
    """All case pairs folded, also those that change a text's length."""
    return _icu(text, "lang.UCharacter", "foldCase")


def traditional(text: Column, table: dict[str, str] | None = None) -> Column:
    """Simplified characters replaced one by one, by a table of pairs: simplified() where none is given."""
    table = simplified() if table is None else table
    return F.translate(text, "".join(table), "".join(table.values()))


def simplified_count(text: Column, table: dict[str, str] | None = None) -> Column:
    """How many characters of a text have a traditional form that differs."""
    return F.length(text) - F.length(F.translate(text, "".join(simplified() if table is None else table), ""))


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")


def comparison_form(text: Column, exact: bool = False) -> Column:
    """The form in which texts are compared: no blanks, no case. exact also folds widths, simplified characters and all case pairs, by ICU."""
    if exact:
        return case_folded(without_blanks(traditional(compatible(text))))
    return without_blanks(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def holds(haystack: Column, needle: Column) -> Column:
    """Whether the exact comparison form of a needle is in that of the haystack; an empty one isn't."""
    n = comparison_form(needle, exact=True)
    return (F.length(n) > 0) & F.contains(comparison_form(haystack, exact=True), n)


def covered(text: Column, values: Column) -> Column:
    """text with the values, in their order, each covered where it first stands free; null if one doesn't."""

    def cover(acc: Column, value: Column) -> Column:
        at = F.position(value, acc)
        return F.when((at > 0) & (value != ""), F.concat(F.substring(acc, F.lit(1), at - 1), F.repeat(F.lit(COVER), F.length(value)), F.substring(acc, at + F.length(value), F.length(acc))))

    return F.aggregate(values, text, cover)


def share(text: Column, script: str) -> Column:
    """Letters of a script among all letters, 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(script)), letters), F.lit(0.0))


def latin_share(text: Column) -> Column:
    return share(text, r"\p{IsLatin}")


def han_share(text: Column) -> Column:
    return share(text, HAN)


def annotated(text: Column) -> Column:
    """struct(utterance, slots, error) of an annotated text; error is null if all brackets were read."""
    kinds = F.regexp_extract_all(text, F.lit(ANNOTATION), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(ANNOTATION), F.lit(2))
    slots = F.zip_with(kinds, values, lambda k, v: F.struct(F.trim(k).alias("type"), F.trim(v).alias("value")))
    plain = F.regexp_replace(text, ANNOTATION, "$2")
    empty = F.exists(slots, lambda s: (s["type"] == "") | (s["value"] == ""))
    error = F.when(empty, "empty slot").when(plain.rlike(r"[\[\]]"), "unread bracket")
    return F.struct(plain.alias("utterance"), slots.alias("slots"), error.alias("error"))


def compact_json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {{name}} filled in; null if a placeholder is left."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return F.when(~F.contains(out, F.lit("{{")), out)


def substituted(text: Column, old: Column, new: Column) -> Column:
    """text with the first occurrence of old replaced; null if there is none."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))
