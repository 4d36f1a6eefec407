"""Substring dedup on words: windows of 13 words that an earlier document has are removed.

anchors.py brings the words around each passage that several documents may share to a shard, once
per content. A shard is indexed by an FM-index: the Burrows-Wheeler transform of its words in a
wavelet tree of packed bits with sampled ranks. The shard's segments are streamed against it, all
windows of a chunk at once: backward search extends each by one word per step, from the last to the
first, and an interval that survives WINDOW steps holds all places of the window. The least
document of an interval keeps its copy. Intervals of equal windows are equal and others disjoint,
so the least document of each is one pass over the sorted intervals.

Results for odd inputs: a null text counts as empty and has no words; texts of fewer words than the
window lose nothing; rows with a null doc_id lose nothing and nothing is lost to them; repeated rows
have one doc_id, so none is smaller and both stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.anchors import Unit, covered, runs_of, searched, with_removed

WINDOW = 13
QUERIES = 100_000
CACHED = 400_000


class WordHashes(dict):
    """64-bit hashes of words, kept for frequent ones within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def _cutter() -> Callable[[str], np.ndarray]:
    known = WordHashes()

    def cut(text: str) -> np.ndarray:
        words = _words_of(text)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return cut


WORDS = Unit(WINDOW, 4, _cutter, lambda units: units, second=10)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places by their first `depth` symbols at least, by doubling the compared length."""
    rank, length, n = symbols.astype(np.int64), 1, len(symbols)
    order = np.argsort(rank)
    while length < depth:
        later = np.zeros(n, np.int64)
        later[: n - length] = rank[length:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key)
        new = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        length *= 2
        if new.all():
            break
    return order


class Bits:
    """A packed bit vector with the count of ones before each 64-bit word."""

    def __init__(self, flags: np.ndarray):
        packed = np.zeros(-(-(len(flags) + 1) // 64) * 8, np.uint8)
        some = np.packbits(flags, bitorder="little")
        packed[: len(some)] = some
        self._words = packed.view("<u8")
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self._before[word] + np.bitwise_count(self._words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class WaveletTree:
    """Ranks in a sequence over a large alphabet, as one bit vector per binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray):
        top = int(symbols.max()) if len(symbols) else 0
        self.digits = max(1, top.bit_length())
        self._levels, self._zeros, rest = [], [], symbols
        for d in range(self.digits - 1, -1, -1):
            flags = (rest >> d & 1).astype(bool)
            self._levels.append(Bits(flags))
            self._zeros.append(int(len(flags) - flags.sum()))
            rest = np.concatenate([rest[~flags], rest[flags]])
        every = np.arange(top + 1)
        self._start = self._descend(every, np.zeros_like(every))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place ends up among the leaves on the way of its symbol."""
        for d, bits, zeros in zip(range(self.digits - 1, -1, -1), self._levels, self._zeros, strict=True):
            ones = bits.ones(at)
            at = np.where(symbol >> d & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbol, at) - self._start[symbol]


class FMIndex:
    """Backward search over a text of symbols; symbol 0 separates and ends."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.order = suffix_order(symbols, depth)
        self._tree = WaveletTree(symbols[self.order - 1])
        self._before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])

    def search(self, patterns: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, low, high) in the suffix order of the rows of patterns whose interval has at least so many places. An
        interval only gets narrower as a pattern is extended, so a row goes as soon as its interval is below that."""
        row = np.arange(len(patterns))
        bounds = np.stack([np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.order), np.int64)])
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[row, k]
            bounds = self._before[symbol] + self._tree.rank(np.tile(symbol, 2), bounds.ravel()).reshape(2, -1)
            wide = bounds[1] - bounds[0] >= least
            if not wide.all():
                row, bounds = row[wide], bounds[:, wide]
        return row, bounds[0], bounds[1]


def resolve(units: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Flags of the windows that a smaller document has, by the FM-index of the shard's segments."""
    n = len(sizes)
    at = np.arange(len(units)) + np.repeat(np.arange(n), sizes)
    symbols = np.zeros(len(units) + n, np.int64)  # with a separator after each segment
    symbols[at] = np.unique(units, return_inverse=True)[1] + 1
    ends = np.cumsum(sizes) + np.arange(n)
    index = FMIndex(symbols, WINDOW + 1)
    owner = np.repeat(np.arange(n), sizes + 1)
    starts = np.nonzero(np.arange(len(symbols)) <= ends[owner] - WINDOW)[0]
    gone = np.zeros(len(symbols), bool)
    doc_in_order = docs[owner[index.order]]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)
    for k in range(0, len(starts), QUERIES):
        some = starts[k : k + QUERIES]
        # A window in one place is nobody else's.
        row, low, high = index.search(windows[some], 2)
        if not len(row):
            continue
        some = some[row]
        first, where = np.unique(low, return_index=True)
        ends = high[where]
        # The intervals are disjoint: their minima by one reduction over begin, end, begin, end, ...
        cuts = np.stack([first, ends], 1).ravel()
        least = np.minimum.reduceat(np.append(doc_in_order, np.iinfo(np.int64).max), cuts)[::2]
        gone[some] = docs[owner[some]] > least[np.searchsorted(first, low)]
    return gone[at]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (remaining words, joined by a space), spans (start, end of the removed runs of words), n_words per row of docs."""
    ready = with_removed(searched(docs), WORDS, resolve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            kept, found, sizes = [], [], []
            texts = [_words_of(t) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            for words, gone, n in zip(texts, covered(batch.column("removed"), lengths, WINDOW), lengths.tolist(), strict=True):
                runs = [] if gone is None else runs_of(gone)
                for a, b in reversed(runs):
                    del words[a:b]
                kept.append(b" ".join(words))
                found.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(found, spans), pa.array(sizes, pa.int64())], names=["doc_id", "kept", "spans", "n_words"])

    return ready.select("doc_id", "text", "removed").mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_words long")
