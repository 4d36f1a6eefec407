"""Best-fit packing in rounds: partitions pack locally by best fit, bins that are nearly full are
done, and all others become items of the next round, which packs the leftovers of many partitions
together, until they fit in one task or a round brings next to nothing.

An item holds the pieces in it with their places, so no later join brings them back. A task packs
blocks of at most BLOCK items, and the leftovers of a round are dealt evenly to as many tasks as hold
ITEMS each, so a task's memory doesn't grow with the input, and every task gets bins of all sizes. When
a round leaves more than 49 of 50 bins, or is a single task's, the bins left are opened once and their
pieces packed by themselves; when that happens again the bins are sequences as they are.

Results for odd inputs: a null or empty text is one piece holding only the end id; repeated rows
are packed as often as they occur; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import forget, small_batches, text_or_empty, written
from lexloom.llm.tokens import Encoder, tokenizer_json

LENGTH = 2048
#: Free tokens with which a bin still counts as full.
SLACK = 8
BLOCK = 200_000
#: Bins that a task merges.
ITEMS = 100_000
#: A bound for the sequences' numbers; each round but the last takes off one bin in fifty at least.
MAX_ROUNDS = 30
END = b"\0\0\0\0"
_PIECES = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece takes the remainder."""
    n = len(ids) // 4
    first = n % length or length
    starts = [0, *range(first, n, length)]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json.value)
        for batch in batches:
            rows = [(i, *p) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in cut(encoder.ids(t) + END, length)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the fullest bin that has room."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    free = 0  # bit r: a bin with r free tokens is open
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        if fits := free >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - size:
            open_bins[left].append(b)
            free |= 1 << left
    return bins


def _round(number: int, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made = 0

        def packed(items: list[tuple[int, list]]) -> pd.DataFrame:
            nonlocal made
            out = []
            for members in best_fit([n for n, _ in items], capacity):
                out.append((sum(items[i][0] for i in members), [p for i in members for p in items[i][1]]))
            rows = []
            for n, inside in out:
                rows.append((number << 58 | task << 32 | made, n, inside, n >= capacity - SLACK))
                made += 1
            return pd.DataFrame(rows, columns=["sequence_id", "filled", "inside", "done"])

        items: list[tuple[int, list]] = []
        for frame in frames:
            items += zip(frame["filled"].tolist(), map(list, frame["inside"]), strict=True)
            if len(items) >= BLOCK:
                yield packed(items)
                items = []
        if items:
            yield packed(items)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece, with its sequence and its place there."""
    for batch in batches:
        inside = batch.column("inside")
        flat, counts = inside.flatten(), inside.value_lengths().to_numpy(zero_copy_only=False)
        length = flat.field("length").to_numpy(zero_copy_only=False)
        before = np.cumsum(length) - length
        offset = before - np.repeat(before[(np.cumsum(counts) - counts)[counts > 0]], counts[counts > 0])
        sequence = np.repeat(batch.column("sequence_id").to_numpy(zero_copy_only=False), counts)
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(sequence), pa.array(offset)], names=[*(f.name for f in flat.type), "sequence_id", "offset"])


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """found (pieces()) with sequence_id and offset: sequences of at most `length` tokens."""
    schema = f"sequence_id long, filled long, inside {_PIECES}, done boolean"
    single = F.array(F.struct(F.col("doc_id").cast("long"), "piece", "start", "length", "ids_crc32")).cast(_PIECES)
    full = found.where(F.col("length") >= length)
    items = found.where(F.col("length") < length).select(F.col("length").alias("filled"), single.alias("inside"))
    number, parts, done, before, opened = 0, 0, [], None, False
    while True:
        packed = written(items.mapInPandas(_round(number, length), schema), f"pack{number}")
        rest = packed.where(~F.col("done"))
        done.append(packed.where("done"))
        left = rest.agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.size("inside")), F.lit(0)).alias("pieces")).first()
        idle = parts == 1 or (before is not None and left.bins > 0.98 * before)
        if not left.bins or number == MAX_ROUNDS or (idle and opened):
            done.append(rest)
            break
        number, before, opened = number + 1, left.bins, opened or idle
        if idle:  # once, the bins that don't go together are opened and their pieces packed anew
            rest = rest.select("sequence_id", F.explode("inside").alias("p")).select("sequence_id", F.col("p.length").alias("filled"), F.array("p").alias("inside"), "p.doc_id", "p.piece")
            before, parts = None, -(-left.pieces // ITEMS)
            items = rest.repartition(parts, F.xxhash64("doc_id", "piece", F.lit(number))).select("filled", "inside")
        else:
            parts = -(-left.bins // ITEMS)
            items = rest.repartition(parts, F.xxhash64("sequence_id", F.lit(number))).select("filled", "inside")
    sequences = reduce(DataFrame.unionByName, done).select("sequence_id", "inside")
    placed = sequences.mapInArrow(_placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # A whole sequence by itself: its number is built from what names the piece.
    alone = full.select("*", (F.monotonically_increasing_id().bitwiseOR(F.lit(31 << 58))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def packed_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """All pieces of docs with their sequence and place; see pieces() and pack()."""
    return pack(written(pieces(docs, length, tokenizer), "pieces"), length)
