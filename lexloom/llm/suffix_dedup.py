"""Suffix-array dedup by external induced sorting: repeats of 50 bytes lose all but the first copy.

anchors.py brings the text around each passage that several documents may share to a shard, once
per content. A shard's text is sorted by induced sorting: only the suffixes at local minima are
sorted by comparing (to the depth that windows need), all others are induced from them in one scan
up and one scan down the alphabet. The scans work on queues, one per first character, that hold
suffixes in order and go to disk beyond a bound; the text itself and the flags of its suffixes stay
in memory, some thirty bytes a byte, so anchors.py keeps shards small, whatever the size of the
input. Scans pop and push whole runs of suffixes. Common prefixes between neighbours in the order, cut at the window
length, tell which windows are equal; the least document of each group keeps its copy.

Results for odd inputs: a null text counts as empty and has no bytes; texts shorter than the window
lose nothing; matches never cross documents; rows with a null doc_id lose nothing and nothing is
lost to them; repeated rows have one doc_id, so none is smaller and both stay as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.anchors import Unit, covered, runs_of, searched, with_removed

WINDOW = 50
#: Suffixes that a shard's queues hold in memory before they go to disk.
QUEUED = 8_000_000
_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


BYTES = Unit(WINDOW, 24, lambda: _bytes_of, lambda units: _TABLE[units], second=40)


class SuffixQueues:
    """First-in-first-out queues of suffixes by first character, spilled to one temporary file."""

    def __init__(self, bound: int = QUEUED):
        self._runs: dict[int, list] = defaultdict(list)
        self._bound, self._held, self._file = bound, 0, None

    def push(self, characters: np.ndarray, suffixes: np.ndarray) -> None:
        """Append suffixes to the queues of their characters, in their order."""
        if not len(suffixes):
            return
        order = np.argsort(characters, kind="stable")
        characters, suffixes = characters[order], suffixes[order]
        begin = np.nonzero(np.concatenate([[True], characters[1:] != characters[:-1]]))[0]
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(suffixes)], strict=True):
            self._runs[int(characters[a])].append(suffixes[a:b])
        self._held += len(suffixes)
        if self._held > self._bound:
            self._spill()

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        for runs in self._runs.values():
            for k, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    at = self._file.seek(0, 2)
                    self._file.write(run.tobytes())
                    runs[k] = (at, len(run), run.dtype)
        self._held = 0

    def pop(self, character: int) -> np.ndarray | None:
        """All suffixes that wait under a character."""
        runs = self._runs.pop(character, None)
        if not runs:
            return None
        out = []
        for run in runs:
            if isinstance(run, np.ndarray):
                self._held -= len(run)
                out.append(run)
            else:
                at, n, kind = run
                self._file.seek(at)
                out.append(np.frombuffer(self._file.read(n * kind.itemsize), kind))
        return np.concatenate(out)


def _is_smaller_than_next(text: np.ndarray) -> np.ndarray:
    """S-type flags: the suffix is smaller than the one after it. The last is not, as the end is smallest."""
    step = np.diff(text)
    nearest = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the next place where neighbours differ
    return np.append(np.append(step > 0, False)[nearest], False)


def words_at(raw: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each place as one number, also from `room` places after the end."""
    one = np.concatenate([raw, np.zeros(room + 8, np.uint8)]).astype(np.uint16)
    two = (one[:-1] << 8 | one[1:]).astype(np.uint32)
    four = (two[:-2] << 16 | two[2:]).astype(np.uint64)
    return four[:-4] << np.uint64(32) | four[4:]


def _sorted_minima(words: np.ndarray, minima: np.ndarray, depth: int) -> np.ndarray:
    """minima (places) by their first `depth` bytes: by the first eight, then ties by the next, and so on."""
    order = minima[np.argsort(words[minima])]
    first = words[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    for at in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        tied = np.nonzero(~alone)[0]
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        key = words[order[tied] + at]
        again = np.lexsort((key, group))
        order[tied] = order[tied][again]
        key = key[again]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order


def suffix_array(raw: np.ndarray, separators: np.ndarray, words: np.ndarray, depth: int, queues: type = SuffixQueues) -> np.ndarray:
    """The places of raw in the order of their suffixes, right to `depth` characters.

    separators: places that sort before all bytes, the last place among them. words: words_at(raw, depth).
    """
    text = raw.astype(np.int16) + 1
    text[separators] = 0
    n = len(text)
    smaller = _is_smaller_than_next(text)
    minima = np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1
    minima = _sorted_minima(words, minima.astype(np.int32), depth)
    seeds, waiting = queues(), queues()
    seeds.push(text[minima], minima)
    top = int(text.max()) + 1

    larger: dict[int, np.ndarray] = {}
    waiting.push(text[n - 1 :], np.array([n - 1], np.int32))
    for c in range(top):
        found = []
        while (run := waiting.pop(c)) is not None:
            found.append(run)
            before = run[run > 0] - 1
            before = before[~smaller[before]]
            waiting.push(text[before], before)
        if (run := seeds.pop(c)) is not None:
            before = run[run > 0] - 1
            waiting.push(text[before], before)
        larger[c] = np.concatenate(found) if found else np.empty(0, np.int32)

    up: list[np.ndarray] = []
    for c in range(top - 1, -1, -1):
        found = []
        while (run := waiting.pop(c)) is not None:
            found.append(run)
            before = run[run > 0] - 1
            before = before[smaller[before]]
            waiting.push(text[before], before)
        run = larger[c][::-1]
        before = run[run > 0] - 1
        before = before[smaller[before]]
        waiting.push(text[before], before)
        up += [*found, run]
    return np.concatenate(up)[::-1] if up else np.empty(0, np.int32)


def common_prefixes(words: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each place in order has its first `window` bytes in common with the one before it."""
    same = np.ones(len(order), bool)
    same[:1] = False
    for at in [*range(0, window - 7, 8), window - 8]:
        check = np.nonzero(same)[0]  # only what was the same so far
        same[check] = words[order[check] + at] == words[order[check - 1] + at]
    return same


def resolve(units: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Flags of the windows that a smaller document has, by the suffix array of the shard's segments."""
    n = len(sizes)
    at = np.arange(len(units), dtype=np.int32) + np.repeat(np.arange(n, dtype=np.int32), sizes)
    raw = np.zeros(len(units) + n, np.uint8)  # with a separator after each segment
    raw[at] = units
    ends = (np.cumsum(sizes) + np.arange(n)).astype(np.int32)
    words = words_at(raw, WINDOW + 6)
    order = suffix_array(raw, ends, words, WINDOW + 6)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    starts = np.arange(len(raw), dtype=np.int32) <= ends[owner] - WINDOW
    order = order[starts[order]]
    group = np.nonzero(~common_prefixes(words, order, WINDOW))[0]
    doc = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(order)))) if len(order) else doc
    gone = np.zeros(len(raw), bool)
    gone[order[doc > least]] = True
    return gone[at]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (remaining bytes), spans (start, end of the removed runs), n_bytes per row of docs."""
    ready = with_removed(searched(docs), BYTES, resolve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            kept, found, sizes = [], [], []
            texts = [_bytes_of(t) for t in batch.column("text").to_pylist()]
            for raw, gone in zip(texts, covered(batch.column("removed"), np.array([len(t) for t in texts], np.int64), WINDOW), strict=True):
                kept.append(raw.tobytes() if gone is None else raw[~gone].tobytes())
                found.append([] if gone is None else [{"start": a, "end": b} for a, b in runs_of(gone)])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(found, spans), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_bytes"])

    return ready.select("doc_id", "text", "removed").mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long")

