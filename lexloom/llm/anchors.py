"""Exact search for windows of N units that several documents share, with little to shuffle.

A window's anchor is the GRAM-unit run in it with the least hash (the leftmost of equals). It is a
function of the window's content, so two documents that share a window share its anchor. Windows
with one anchor form a segment: the units from the first of them to the end of the last.

1. `shared_anchors`: tasks send each anchor's hash once per task (to a bucket by its hash), with one
   document that has it. Anchors that several documents of one task have are known there already,
   so their documents aren't sent: a passage of a third of all documents costs each task one entry.
   A bucket returns to (document, hash) what it saw twice.
   Anchors that more than HOT documents have are hot: their windows get a second, longer anchor, so
   the many surroundings of one passage don't end in one bucket.
2. `segments`: of the documents with shared anchors, the segments of these, again once per task and
   content: of equal segments in a task all but the least document's lose all their windows at
   once, as a smaller document has the same.
3. A resolver takes the segments of a bucket and finds, window by window, the least document.
4. `removed`: the windows found, as maximal runs of units per document.

Everything is keyed by hashes of content or by document; nothing is gathered by source or by group
of copies, and only step 1 sees all units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import forget, input_bytes, release, small_batches, text_or_empty, written

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xFFFF)
#: Windows that are hashed at a time; a place within has to fit in 16 bits.
CHUNK = 1 << 15
#: Bytes of (compressed) input per partition, and buckets of segments in one; a task holds one bucket at a time.
PARTITION_BYTES, BUCKETS = 5 << 20, 8
#: Entries, and bytes of segments, that a task holds before it sends them.
HELD = 1_500_000
HELD_BYTES = 24 << 20
#: Documents from which an anchor is hot.
HOT = 500
#: Segments whose units are copied out at a time.
SENT = 20_000


@dataclass(frozen=True)
class Unit:
    """What windows of `window` units consist of, and the length of their anchors."""

    window: int
    gram: int
    #: A maker, per task, of a function from a text to an array of its units (bytes, or 64-bit hashes of words).
    cutter: Callable[[], Callable[[str], np.ndarray]]
    #: Unsigned 64-bit hashes of an array of units.
    hashed: Callable[[np.ndarray], np.ndarray]
    #: The length of second anchors.
    second: int = 0


def _anchors(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of each window of at most CHUNK windows."""
    done, size, out, at, left = units, 1, None, 0, gram
    n = len(units) - gram + 1
    while left:
        if left & 1:
            out = done[at : at + n] if out is None else out * _MIX + done[at : at + n]
            at += size
        left >>= 1
        if left:
            done = (done[:-size] * _MIX + done[size:]) * _MIX  # not the same in both halves
            done ^= done >> np.uint64(31)
            size *= 2
    h = out * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    least = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    windows = len(units) - window + 1
    least = np.minimum(least[:windows], least[span - size : span - size + windows])
    return least & ~_PLACE, (least & _PLACE).astype(np.int64)


def segments_of(texts: list[np.ndarray], unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of each array of units: number of the array, first window, count of windows, anchor's hash."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    total, window = int(ends[-1]) if len(ends) else 0, unit.window
    if total < window:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    units = np.concatenate(texts)
    starts, hashes, counts, places = [], [], [], []
    for at in range(0, total - window + 1, CHUNK):
        h, p = _anchors(unit.hashed(units[at : at + CHUNK + window - 1]), window, unit.gram)
        hashes.append(h)
        places.append(p + at)
    h, p = np.concatenate(hashes), np.concatenate(places)
    inside = np.ones(len(h), bool)
    for k in range(1, window):  # windows that reach into the next text
        late = ends - k
        inside[late[(late >= 0) & (late < len(h))]] = False
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(p[1:], p[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    new &= inside
    starts = np.nonzero(new)[0]
    counts = np.diff(np.append(np.cumsum(inside)[starts], np.cumsum(inside)[-1] + 1)) if len(starts) else np.empty(0, np.int64)
    which = np.searchsorted(ends, starts, side="right")
    return which, starts - (ends - lengths)[which], counts.astype(np.int64), h[starts]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64) % buckets


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal sorted keys begin."""
    return np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, np.int64)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the groups of equal sorted keys."""
    begin = _grouped(keys).tolist()
    return list(zip(begin, [*begin[1:], len(keys)], strict=True)) if begin else []


_ENTRY = [("hash", "<u8"), ("doc", "<i8")]
#: A document of an entry that needs no answer, as its task knows already.
_ANSWERED = -(2**63)
#: Rows of a batch that goes back to Spark.
ROWS = 100_000


def _batches(**columns) -> Iterator[pa.RecordBatch]:
    """Columns (numpy or Arrow arrays) as batches of at most ROWS rows."""
    made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    for at in range(0, made.num_rows, ROWS):
        yield made.slice(at, ROWS)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)


def _shared_anchors(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """doc_id and hash of the anchors that other documents have too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = unit.cutter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[new], d[new]
            begin = _grouped(h)
            size = np.diff(np.append(begin, len(h)))
            told = np.repeat(size > 1, size)
            n = int(told.sum())
            yield from _batches(bucket=(d[told] % buckets).astype(np.int32), doc_id=d[told], hash=h[told].view(np.int64), data=pa.nulls(n, pa.binary()))
            entries = np.empty(len(begin), _ENTRY)
            entries["hash"], entries["doc"] = h[begin], np.where(size > 1, _ANSWERED, d[begin])
            to = _bucket(entries["hash"], buckets)
            order = np.argsort(to, kind="stable")
            entries, to = entries[order], to[order]
            spans = _spans(to)
            data, n = pa.array([entries[a:b].tobytes() for a, b in spans], pa.binary()), len(spans)
            yield from _batches(bucket=to[[a for a, _ in spans]].astype(np.int32), doc_id=pa.nulls(n, pa.int64()), hash=pa.nulls(n, pa.int64()), data=data)

        n = 0
        for batch in batches:
            ids = _numbers(batch, "doc_id")
            which, _, _, hashes = segments_of([cut(t) for t in batch.column("text").to_pylist()], unit)
            if len(hashes):
                held.append((hashes, ids[which].astype(np.int64)))
                n += len(hashes)
            if n >= HELD:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            entries = np.frombuffer(b"".join(blobs), _ENTRY)
            entries = entries[np.argsort(entries["hash"])]
            begin = _grouped(entries["hash"])
            size = np.diff(np.append(begin, len(entries)))
            found = entries[np.repeat(size > 1, size) & (entries["doc"] != _ANSWERED)]
            yield from _batches(doc_id=found["doc"].astype(np.int64), hash=found["hash"].astype(np.uint64).view(np.int64))

        bucket, blobs = None, []
        for batch in batches:
            yield batch.filter(batch.column("doc_id").is_valid()).select(["doc_id", "hash"])
            asked = batch.filter(batch.column("doc_id").is_null())
            for b, x in zip(asked.column("bucket").to_pylist(), asked.column("data").to_pylist(), strict=True):
                if b != bucket:
                    if blobs:
                        yield from settle(blobs)
                    bucket, blobs = b, []
                blobs.append(x)
        if blobs:
            yield from settle(blobs)

    sent = docs.mapInArrow(send, "bucket int, doc_id long, hash long, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(answer, "doc_id long, hash long")


#: From a resolver: units of segments one after the other, their sizes in units, their documents (the least that has each);
#: back comes a flag for each unit, set where a window starts that a smaller document has.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Contents:
    """Hashes of runs of units (two at least): prefix sums of a polynomial, whose powers are kept."""

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self._powers = self._inverses = np.ones(1, np.uint64)

    def of(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        # Pairs of neighbours are scrambled first: a polynomial of the units themselves has known collisions modulo 2^64.
        last = hashes[start + size - 1] * np.uint64(0xD6E8FEB86659FD93)
        hashes = hashes[:-1] * _MIX + hashes[1:]
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(27)
        n = len(hashes) + 1
        if n > len(self._powers):
            for name, base in (("_powers", self._BASE), ("_inverses", pow(self._BASE, -1, 2**64))):
                factors = np.full(2 * n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self._powers[: n - 1])])
        h = (sums[start + size - 1] - sums[start]) * self._inverses[start] + size.astype(np.uint64) * _MIX
        h += last ^ (last >> np.uint64(29))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _gathered(units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The units of runs, one after the other."""
    at = np.cumsum(size) - size
    return units[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def _binary(units: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size * units.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(units.tobytes())])


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows; those that go on where another ends are put together."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    if not len(doc):
        return doc, start, n
    begin = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])]))[0]
    return doc[begin], start[begin], np.add.reduceat(n, begin)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def removed_windows(docs: DataFrame, unit: Unit, resolver: Resolver) -> DataFrame:
    """doc_id, start, n: each window start to start + n - 1 of doc_id also starts in a document with a smaller id."""
    parts = max(16, min(1_000_000, input_bytes(docs) // PARTITION_BYTES))
    buckets = parts * BUCKETS
    shared = written(_shared_anchors(docs, unit, parts), "anchors")
    release(docs.sparkSession)
    hot = shared.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", F.lit(True).alias("hot"))
    asked = shared.join(hot, "hash", "left").groupBy("doc_id").agg(F.collect_list("hash").alias("data"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hot"))
    # Written, so that all shuffles up to here can go before the segments are shuffled.
    asked = written(docs.join(asked, "doc_id").select("doc_id", "text", "data", "hot"), "asked")
    forget(shared)
    release(docs.sparkSession)
    window, finer = unit.window, replace(unit, gram=unit.second)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, contents = unit.cutter(), Contents()
        held: list[tuple] = []  # key, doc, start, n, place in the held units, anchor
        texts: list[np.ndarray] = []
        n_held = weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, start, n, place, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            units = np.concatenate(texts)
            held.clear()
            texts.clear()
            order = np.lexsort((start, doc, key))
            key, doc, start, n, place, anchor = (x[order] for x in (key, doc, start, n, place, anchor))
            begin = _grouped(key)
            first = np.zeros(len(key), bool)
            first[begin] = True
            least = doc == np.repeat(doc[begin], np.diff(np.append(begin, len(key))))
            to = _bucket(anchor, buckets).astype(np.int32)
            # The least document's segments go to the bucket, the first of equal ones with its units; the others are settled.
            for k in range(0, len(begin), SENT):
                row = begin[k : k + SENT]
                length = n[row] + window - 1
                yield from _batches(bucket=to[row], doc_id=doc[row], start=start[row], n=n[row], key=key[row].view(np.int64), data=_binary(_gathered(units, place[row], length), length))
            again = least & ~first
            yield from _batches(bucket=to[again], doc_id=doc[again], start=start[again], n=n[again], key=key[again].view(np.int64), data=pa.nulls(int(again.sum()), pa.binary()))
            d, s, m = _merged(doc[~least], start[~least], n[~least])
            yield from _batches(bucket=(d % buckets).astype(np.int32), doc_id=d, start=s, n=m, key=pa.nulls(len(d), pa.int64()), data=pa.nulls(len(d), pa.binary()))

        for batch in batches:
            ids = _numbers(batch, "doc_id").astype(np.int64)
            cuts = [cut(t) for t in batch.column("text").to_pylist()]
            which, start, count, hashes = segments_of(cuts, unit)

            def listed(name: str) -> np.ndarray:
                data = batch.column(name)
                asked_by = np.repeat(np.arange(len(ids)), data.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.uint64)
                asked_for = data.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                return np.isin(hashes ^ (which.astype(np.uint64) * _MIX), asked_for ^ (asked_by * _MIX))

            wanted = listed("data")
            which, start, count, hashes = which[wanted], start[wanted], count[wanted], hashes[wanted]
            if not len(which):
                continue
            lengths = np.array([len(c) for c in cuts], np.int64)
            units = np.concatenate(cuts)
            base = np.cumsum(lengths) - lengths
            if (many := listed("hot")).any():
                at = np.nonzero(many)[0]
                spans = zip((base[which[at]] + start[at]).tolist(), (count[at] + window - 1).tolist(), strict=True)
                k, s, n, h = segments_of([units[a : a + m] for a, m in spans], finer)
                which, start, count, hashes = (
                    np.concatenate([x[~many], y]) for x, y in zip((which, start, count, hashes), (which[at][k], start[at][k] + s, n, (hashes[at][k] ^ h) * _MIX), strict=True)
                )
            place = base[which] + start
            key = contents.of(unit.hashed(units), place, count + window - 1)
            held.append((key, ids[which], start, count, place + n_held, hashes))
            texts.append(units)
            n_held += len(units)
            weight += units.nbytes + 48 * len(key)
            if weight >= HELD_BYTES:
                yield from flush()
                n_held = weight = 0
        if held:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = unit.cutter()("x").dtype

        def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, doc, start, n = (np.concatenate([_numbers(p, c) for p in parts]) for c in ("key", "doc_id", "start", "n"))
            data = pa.chunked_array([p.column("data") for p in parts])
            empty = data.is_null().to_numpy()
            order = np.lexsort((empty, doc, key))  # of the least document, the row with the units first
            key, doc, start, n = key[order], doc[order], start[order], n[order]
            begin = _grouped(key)
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
            units = np.frombuffer(b"".join(x for c in data.take(pa.array(order[begin])).chunks for x in c.to_pylist()), kind)
            sizes = n[begin] + window - 1
            flags = resolver(units, sizes, doc[begin])
            least = doc == doc[begin][group]
            out = [(doc[~least], start[~least], n[~least])]
            runs = runs_of(flags)
            if runs:  # of each content, for each of the least document's segments with it
                a, b = np.array(runs, np.int64).T
                base = np.cumsum(sizes) - sizes
                g = np.searchsorted(base, a, side="right") - 1
                repeat = np.bincount(group[least], minlength=len(begin))[g]
                row = np.repeat(begin[g] - (np.cumsum(repeat) - repeat), repeat) + np.arange(int(repeat.sum()))
                out.append((doc[row], start[row] + np.repeat(a - base[g], repeat), np.repeat(b - a, repeat)))
            d, s, m = _merged(*(np.concatenate(x) for x in zip(*out, strict=True)))
            yield from _batches(doc_id=d, start=s, n=m)

        bucket, parts = None, []
        for batch in batches:
            told = batch.column("key").is_null()
            yield batch.filter(told).select(["doc_id", "start", "n"])
            rest = batch.filter(batch.column("key").is_valid())
            for a, b in _spans(_numbers(rest, "bucket")):
                this = rest.column("bucket")[a].as_py()
                if this != bucket:
                    if parts:
                        yield from settle(parts)
                    bucket, parts = this, []
                parts.append(rest.slice(a, b - a))
        if parts:
            yield from settle(parts)

    sent = asked.mapInArrow(send, "bucket int, doc_id long, start long, n long, key long, data binary")
    resolved = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, "doc_id long, start long, n long")
    found = written(resolved, "removed")
    forget(asked)
    release(docs.sparkSession)
    return found


def searched(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def with_removed(docs: DataFrame, unit: Unit, resolver: Resolver) -> DataFrame:
    """docs (doc_id, text) with `removed`: runs (start, n) of windows, null if there are none."""
    found = removed_windows(docs.where("doc_id IS NOT NULL"), unit, resolver)
    gathered = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("removed"))
    return docs.join(gathered, "doc_id", "left")


def covered(removed: pa.Array, sizes: np.ndarray, window: int) -> list[np.ndarray | None]:
    """For each row, flags of the units that its removed windows cover; None if it has none. sizes: units per row."""
    count = removed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = removed.flatten()
    start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
    row = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    change = np.zeros(int((sizes + 1).sum()), np.int64)
    np.add.at(change, base[row] + np.minimum(start, sizes[row]), 1)
    np.add.at(change, base[row] + np.minimum(start + n + window - 1, sizes[row]), -1)
    gone = np.cumsum(change) > 0
    return [gone[b : b + k] if c else None for b, k, c in zip(base.tolist(), sizes.tolist(), count.tolist(), strict=True)]
