"""Compression bands: zstandard ratios of whole documents and of fixed chunks reject text that
repeats itself or that does not compress, with limits that depend on length.

Results for odd inputs: a null text counts as empty; an empty text has no words and fails the base
rules; other columns are kept as they are, and columns named like the measures are replaced.
Every row is measured by itself, so repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import BLANKS, small_batches

SYMBOLS = b"#*$%&|<>"
_ASCII_BLANKS = BLANKS.decode()


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least `from_bytes` bytes: compressed size / size."""

    from_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    #: General figures at level 3: prose of a few KB comes down to 0.40 to 0.60 and long prose to 0.33 to 0.50; base64 stays
    #: at 0.75 and random letters at 0.65, whatever the length; a paragraph said three times is at 0.25 or below. Short
    #: texts compress less, as zstandard's frame and literals weigh more.
    whole: tuple[Band, ...] = (Band(0, 0.0, 9.0), Band(64, 0.42, 1.20), Band(256, 0.36, 0.90), Band(1024, 0.31, 0.73), Band(8192, 0.26, 0.63))
    chunk_bytes: int = 2048
    chunk_low: float = 0.30
    chunk_high: float = 0.73
    #: Part of a document's bytes that may lie in chunks outside the band.
    max_odd_chunks: float = 0.20


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = [*[(c, pa.int64()) for c in COLUMNS], ("base_failed", pa.bool_()), ("zstd_ratio", pa.float64()), ("odd_chunks", pa.float64()), ("kept", pa.bool_())]
_DDL = [*["long"] * len(COLUMNS), "boolean", "double", "double", "boolean"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-1] * len(ids) + w[1:]
    _, pair = np.unique(pair, return_inverse=True)
    window = pair[:-1] * len(ids) + w[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= again
    return int(mark.sum())


def measure(text: str, rules: Rules, zstd: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(_ASCII_BLANKS)]
    repeats = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    ratio = len(zstd.compress(raw)) / len(raw) if raw else 0.0
    band = [b for b in rules.whole if len(raw) >= b.from_bytes][-1]
    size = rules.chunk_bytes
    chunks = [raw[i : i + size] for i in range(0, len(raw), size)]
    if len(chunks) > 1 and len(chunks[-1]) < size // 2:
        chunks[-2:] = [chunks[-2] + chunks[-1]]  # too short to be held to the band of a whole chunk
    odd = 0.0
    if len(raw) >= size:
        odd = sum(len(x) for x in chunks if not rules.chunk_low <= len(zstd.compress(x)) / len(x) <= rules.chunk_high) / len(raw)
    kept = not failed and band.low <= ratio <= band.high and odd <= rules.max_odd_chunks
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, ratio, odd, kept


def measured(docs: DataFrame, rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """docs with the base measures, the two compression measures and the verdict `kept` per row; their names begin with prefix."""
    small_batches(docs.sparkSession)
    names = [f"{prefix}{c}" for c, _ in _ADDED]
    docs = docs.drop(*names)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"{n} {kind}" for n, kind in zip(names, _DDL, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            rows = [measure(t or "", rules, zstd) for t in batch.column("text").to_pylist()]
            added = zip(*rows, strict=True) if rows else [()] * len(_ADDED)
            columns = [pa.array(v, kind) for v, (_, kind) in zip(added, _ADDED, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they came with."""
    return measured(docs, rules, "_lexloom_").where("_lexloom_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
