"""Near duplicates by HyperMinHash over word shingles.

1. Each document's shingle set gets a digest and REGISTERS registers: for each of as many hash
   functions, the least hash value, stored as its count of leading zeros and MANTISSA further bits.
   Documents with the same set form a class with the least doc_id as its representative.
2. Registers are banded. Representatives that share a band key are candidates of each other; the
   components of "shares a key" are candidate groups. No pairs are made for that, only links to
   the least member of a key.
3. Each group's sets meet in tasks, in blocks of bounded size. Within a block, pairs are estimated
   from the registers, corrected for chance collisions of the shortened values; pairs that may
   reach the similarity are verified on the full sets in falling order of the estimate, but only
   while their ends aren't connected yet. What leaves a task is a spanning forest of real links.
4. Groups larger than a block are dealt into blocks twice, by different hashes, and then every
   member outside the group's largest component travels to all blocks, in slices as small as blocks.
   So each pair is either compared or already connected, a task holds two blocks at most, and a
   large group of copies costs no quadratic work.
5. The links' components are the result.

Results for odd inputs: a null or empty text has no shingles, and is its own component; a text of
fewer words than a shingle is one shingle; repeated rows fall in one class; a null doc_id is its own
component (null) and kept; other columns aren't carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.components import components
from lexloom.llm.shared import small_batches, text_or_empty, written

REGISTERS, MANTISSA = 125, 10
BAND = 5
#: Standard deviations of the estimate below the threshold that still go to verification.
MARGIN = 4.0
BLOCK_BYTES, BLOCK_MEMBERS = 48 << 20, 2500
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(20).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; `known` keeps those of frequent words, within bounds."""
    if len(known) > 300_000:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            known[w] = h
        out[k] = h
    return out


def shingles(text: str, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of `size` words, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, known)
    k = min(size, len(h))
    n = len(h) - k + 1
    run = np.full(n, k, np.uint64)
    for i in range(k):
        run = _scramble(run * _MIX + h[i : i + n])
    return np.unique(run)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash: leading zeros (6 bits) and mantissa of the least value under each hash function."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] * _ODD
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(0), out=least)
    # frexp rounds to 53 bits, far below the mantissa's ten.
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> list[int]:
    keys = np.zeros(REGISTERS // BAND, np.uint64)
    bands = regs.reshape(-1, BAND).astype(np.uint64)
    keys += np.arange(len(keys), dtype=np.uint64) * _MIX
    for i in range(BAND):
        keys = _scramble(keys + bands[:, i] + _MIX)
    return keys.view(np.int64).tolist()


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets of sizes a and b agree: cells of relative width
    2^-MANTISSA (0.72 of it on average within a power of two) under two exponential minima."""
    return 0.7213 * 2.0**-MANTISSA * a * b / (a + b) ** 2


def links(ids: list[int], sizes: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], percent: int, travels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union. With `travels`, only pairs with a traveller count."""
    n = len(ids)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    wanted = percent / 100
    least = wanted - MARGIN * np.sqrt(wanted * (1 - wanted) / REGISTERS)
    first, second, score = [], [], []
    step = max(1, 4_000_000 // (n * REGISTERS))
    size = sizes.astype(np.float64)
    for i in range(0, n, step):
        j = slice(i, n)
        equal = (regs[i : i + step, None, :] == regs[None, j, :]).mean(2)
        c = chance(size[i : i + step, None], size[None, j])
        estimate = (equal - c) / (1 - c)
        low, high = np.minimum(size[i : i + step, None], size[None, j]), np.maximum(size[i : i + step, None], size[None, j])
        good = (estimate >= least) & (low >= wanted * high - 1e-9)
        good &= np.arange(i, n)[None, :] > np.arange(i, min(n, i + step))[:, None]
        if travels is not None:
            good &= travels[i : i + step, None] | travels[None, j]
        a, b = np.nonzero(good)
        first.append((a + i).astype(np.int32))
        second.append((b + i).astype(np.int32))
        score.append(estimate[a, b].astype(np.float32))
    a, b, score = np.concatenate(first), np.concatenate(second), np.concatenate(score)
    order = np.argsort(-score, kind="stable")
    a, b, out = a[order], b[order], []
    for i in range(0, len(a), 4096):
        label = np.array([find(x) for x in range(n)]) if len(a) > 4096 else None
        for x, y in zip(a[i : i + 4096].tolist(), b[i : i + 4096].tolist(), strict=True):
            if label is not None and label[x] == label[y]:
                continue
            p, q = find(x), find(y)
            if p != q:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    root[q] = p
                    out.append((ids[x], ids[y]))
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest and band keys per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [shingles(t, size, known) for t in batch.column("text").to_pylist()]
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in found]
            keys = [band_keys(registers(s)) if len(s) else [] for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "high", "low", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, keys array<long>")


def _with_sets(members: DataFrame, size: int) -> DataFrame:
    """members (doc_id, text, grp, blocks) with registers and set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [shingles(t, size, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "grp", "blocks")), pa.array([registers(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                names=["doc_id", "grp", "blocks", "regs", "hashes"],
            )

    return members.select("doc_id", "text", "grp", "blocks").mapInArrow(run, "doc_id long, grp long, blocks int, regs binary, hashes binary")


def _linked(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found within each (grp, block) of dealt: doc_id, grp, block, travels, regs, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            regs = np.array([np.frombuffer(r[3], np.uint16) for r in rows])
            travels = np.array([r[2] for r in rows], bool)
            found = links([r[1] for r in rows], np.array([len(s) for s in sets]), regs, sets, percent, travels if travels.any() else None)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            for grp, block, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "doc_id", "travels", "regs", "hashes")), strict=True):
                if (grp, block) != key:
                    if len(rows) > 1:
                        yield flush(rows)
                    key, rows = (grp, block), []
                rows.append((None, *row))
        if len(rows) > 1:
            yield flush(rows)

    return dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "doc_id").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), kept, n_copies (rows with the same set) for each row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = written(_signed(docs, size), "signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "high", "low"]
    classes = usable.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    classed = written(signed.drop("keys").join(classes, same, "left"), "classed")

    # One row per class: the keys of the representative.
    keyed = usable.join(classes.select(*same, F.col("first_id").alias("doc_id")), [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"])
    keys = written(keyed.select("doc_id", F.explode("keys").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least")
    stars = keys.join(shared, "key").where("doc_id <> least").select("doc_id", "least").distinct()
    groups = components(stars, "groups").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))

    sizes = signed.select("doc_id", "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    weighed = groups.join(sizes, "doc_id").groupBy("grp").agg(F.sum(F.col("n_shingles") * 8 + 300).alias("bytes"), F.count("*").alias("members"))
    blocks = weighed.select("grp", F.ceil(F.greatest(F.col("bytes") / block_bytes, F.col("members") / block_members)).cast("int").alias("blocks"))
    members = docs.join(groups.join(blocks, "grp"), "doc_id")
    sets = written(_with_sets(members, size), "sets")

    def in_block(salt: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col("blocks")).cast("int")

    found = written(_linked(sets.select("*", in_block(1).alias("block"), F.lit(False).alias("travels")), percent), "links")
    if wide := sets.where("blocks > 1").limit(1).count():
        again = _linked(sets.where("blocks > 1").select("*", in_block(2).alias("block"), F.lit(False).alias("travels")), percent)
        found = written(found.union(again), "links")
    joined = components(found, "linked")
    if wide:
        found = written(found.union(_travelled(sets.where("blocks > 1"), joined, in_block(1), percent, block_members)), "links")
        joined = components(found, "linked")
    first = joined.select(F.col("node").alias("first_id"), F.col("component").alias("component_id"))
    out = classed.join(first, "first_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_copies", F.lit(1))).otherwise(1).alias("n_copies"))


def _travelled(sets: DataFrame, joined: DataFrame, block: Column, percent: int, block_members: int) -> DataFrame:
    """Links of members outside their group's largest component with all members of the group."""
    found = joined.select(F.col("node").alias("doc_id"), "component")
    placed = sets.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("grp", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    placed = placed.join(largest, "grp").withColumn("travels", F.col("component") != F.col("largest"))
    # Travellers go in slices of bounded size: a task holds a block of the others and a slice, or two slices.
    slices = placed.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.count_if("travels") / block_members)).cast("int").alias("slices"))
    placed = placed.join(slices, "grp").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("slices")).cast("int"))
    blocks, n, each = F.col("blocks"), F.col("slices"), lambda count: F.sequence(F.lit(0), count - 1)
    stay = placed.where("NOT travels").withColumn("block", F.explode(F.transform(each(n), lambda j: block * n + j)))
    met = F.transform(each(blocks), lambda i: i * n + F.col("slice"))
    others = F.transform(F.filter(each(n), lambda j: j != F.col("slice")), lambda j: blocks * n + F.least(j, F.col("slice")) * n + F.greatest(j, F.col("slice")))
    go = placed.where("travels").withColumn("block", F.explode(F.concat(met, others)))
    columns = ["doc_id", "grp", "block", "travels", "regs", "hashes"]
    return _linked(stay.select(*columns).union(go.select(*columns)), percent)


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component; of rows with the same doc_id and text, one, and of one doc_id each different text."""
    keep = near_duplicates(docs, size, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_lexloom_id")).distinct()
    one = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return one.join(keep, one["doc_id"].cast("long") == F.col("_lexloom_id"), "left_semi").union(docs.where(F.col("doc_id").isNull()))
