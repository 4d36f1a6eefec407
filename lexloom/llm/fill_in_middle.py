"""Fill-in-middle examples: a text is cut at two ranks of its units and its middle is put last.

A unit is a run of ASCII letters or one other code point. Both ranks follow from the document's id and
the number of units, and the matcher is read twice in constant memory: the first pass counts units, the
second advances a lazy iterator of matches to both ranks and keeps two offsets. No list of units is made,
so a task's memory is its batch of texts and their outputs, which stays small for texts of any length.

Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), with the
marks <P>, <S> and <M>. A text that holds a mark stays plain, so every output can be undone: a mark can't
arise where texts meet, as it begins with its only "<" and ends with its only ">".

Results for odd inputs: null and empty texts are plain with no units; a null id is hashed as no digits,
so such rows of equal length are cut alike; repeated rows give repeated results; an empty table gives no
rows. Further columns of the input are kept; a column named like a result is replaced by the result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.shared import small_batches

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are left plain from here on, and of the others that are suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
RESULTS = "n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, output STRING"


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def units(text: str) -> int:
    """First pass: how many units a text has."""
    counter = count()
    deque(zip(UNIT.finditer(text), counter), maxlen=0)  # a missing match ends zip before it asks the counter
    return next(counter)


def offsets(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the code points before the units of rank low and high, low <= high."""
    ends = (m.end() for m in UNIT.finditer(text))
    first = next(islice(ends, low - 1, None)) if low else 0
    return first, next(islice(ends, high - low - 1, None)) if high > low else first


def transformed(text: str, doc_id: int | None, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    n = units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = offsets(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output."""
    small_batches(docs.sparkSession)
    results = [part.split()[0] for part in RESULTS.split(", ")]
    # What is kept travels as one struct, so names can't clash.
    kept = [c for c in docs.columns if c not in results]
    narrow = docs.select(F.struct(*map(_quoted, kept)).alias("row"), _quoted(text).alias("text"), _quoted(key).cast("long").alias("key"))
    schema = T.StructType([narrow.schema["row"], *T.StructType.fromDDL(RESULTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transformed(t or "", k, seed) for t, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [batch.column("row"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", *results])

    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *results)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by built-in functions."""

    def after(value: Column, mark: str) -> Column:
        return F.substring(value, F.position(F.lit(mark), value) + len(mark), F.length(value))

    def before(value: Column, mark: str) -> Column:
        return F.substring(value, F.lit(1), F.position(F.lit(mark), value) - 1)

    middle = after(output, MIDDLE)
    outer = F.substring(before(output, MIDDLE), F.lit(len(PREFIX) + 1), F.length(output))
    return (
        F.when(form == "psm", F.concat(before(outer, SUFFIX), middle, after(outer, SUFFIX)))
        .when(form == "spm", F.concat(after(outer, PREFIX), middle, before(outer, PREFIX)))
        .otherwise(output)
    )
