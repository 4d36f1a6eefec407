"""Nearest neighbours by cosine, and the order-dependent decisions on duplicates, outliers and contamination.

Vectors are compared in blocks: a block of queries meets a share of the references' blocks in a task, as matrix
products of a fixed size, and only each query's best match leaves it. References aren't broadcast; blocks are
rows of bytes that are written once and read by the tasks, so neither a task's memory nor what a vector costs to
shuffle grows with the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.sources.tables import kept

#: Vectors of one side in a block.
BLOCK = 4096
#: Similarities a task holds at a time; shares of the references, each of so many blocks at most before there are more.
TILE, SHARES, SHARE_BLOCKS = 1 << 19, 8, 32
#: Pivots at most, a bounded sample; and how much an angle may be off by rounding.
PIVOTS, SLACK = 256, 1e-6
#: Repeated vectors up to so many bytes are sent to all tasks; more are joined by a shuffle, in SALTS parts.
FEW_BYTES, SALTS = 16 << 20, 16
#: Rounds of decisions that are planned together.
ROUNDS = 2


@dataclass(frozen=True)
class Thresholds:
    """Inclusive limits of cosine similarity."""

    duplicate: float
    too_close: float
    outlier: float
    contamination: float

    def __post_init__(self):
        if not all(-1 <= t <= 1 for t in (self.duplicate, self.too_close, self.outlier, self.contamination)):
            raise ValueError("thresholds lie between -1 and 1")
        if self.outlier >= self.too_close:
            raise ValueError("the outlier limit is below the limit for being too close")


def unit(v: Column) -> Column:
    """v divided by its length; a length of zero is an error when it runs."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(F.raise_error(F.lit("a vector has no length")).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packed(vectors: DataFrame, n: int) -> DataFrame:
    """(block, ids, ords, vecs): n vectors (id, ord, vec) as rows of up to BLOCK each, ordered by ord, as bytes. Each vector is shuffled and written once."""
    size = BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ords, vecs in _slices(batches, size):
            order = np.lexsort((-ids, ords))
            yield pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in (ids, ords, vecs)], ["ids", "ords", "vecs"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("vec").cast("array<double>").alias("vec"))
    parts = max(1, -(-n // BLOCK))
    out = rows.repartition(parts, "id").mapInArrow(pack, "ids binary, ords binary, vecs binary").coalesce(parts)
    return kept(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, ords and vectors of size rows at a time."""
    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            held.append((part.column("id").to_numpy(zero_copy_only=False), part.column("ord").to_numpy(zero_copy_only=False), _matrix(part.column("vec"))))
            count += part.num_rows
            if count >= size:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield tuple(x[:size] for x in whole)
                held, count = [tuple(x[size:] for x in whole)], count - size
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), lengths[0])


def _meet(queries: DataFrame, references: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """run(pairs of blocks) over all pairs of two packed() tables; blocks is the number of references' blocks.

    A task has a block of queries and a share of the references, and reads both where they are kept: what is shuffled
    and written doesn't grow with the number of pairs. There are SHARES shares, and more only where one would be too large.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs in groupby(_unpacked(batches), key=lambda pair: pair[0]):
            yield from run(pair[1:] for pair in pairs)

    shares = max(SHARES, -(-blocks // SHARE_BLOCKS))
    right = references.select(*[F.col(c).alias(f"other_{c}") for c in ("ids", "ords", "vecs")]).coalesce(shares)
    return queries.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(each, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, (ids, ords, vecs) of the queries, those of the references) of each row."""

    def side(batch: pa.RecordBatch, k: int, names: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, ords, vecs = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in zip(names, (np.int64, np.int64, np.float64), strict=True))
        return ids, ords, vecs.reshape(len(ids), -1)

    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("block")[k].as_py(), side(batch, k, ("ids", "ords", "vecs")), side(batch, k, ("other_ids", "other_ords", "other_vecs"))


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, similarities of some rows of a with all of b), rounded, so that ties don't depend on the order of addition; TILE of them at a time."""
    step = max(1, TILE // len(b))
    for at in range(0, len(a), step):
        s = a[at : at + step] @ b.T
        yield at, np.round(s, 9, out=s)


def _first_dims(v: np.ndarray, width: int | None) -> np.ndarray:
    if width is None:
        return v
    norm = np.linalg.norm(v[:, :width], axis=1, keepdims=True)
    if not norm.all():
        raise ValueError(f"a vector has no length in its first {width} dimensions")
    return v[:, :width] / norm


def _best(queries: DataFrame, references: DataFrame, blocks: int, widths: tuple[int | None, ...] = (None,), exclude_self: bool = False) -> DataFrame:
    """(width, id, m): similarity, o (less ord) and nearest_id of each query's best match by width, over packed() tables. Queries without a reference are left out."""

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        tops: dict = {}
        for (ids, _, vecs), (other_ids, other_ords, others) in pairs:
            own = np.isin(ids, other_ids) if exclude_self else None
            for width in widths:
                top = tops.setdefault(width, (ids, np.full(len(ids), -2.0), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)))
                for at, s in _tiles(_first_dims(vecs, width), _first_dims(others, width)):
                    if exclude_self and (here := np.flatnonzero(own[at : at + len(s)])).size:
                        s[here] = np.where(ids[at + here][:, None] == other_ids[None, :], -2.0, s[here])
                    k = s.argmax(1)
                    _improve([x[at : at + len(s)] for x in top[1:]], s[np.arange(len(s)), k], other_ords[k], other_ids[k])
        for width, (ids, similarity, ords, nearest) in tops.items():
            found = similarity > -2.0
            yield pa.RecordBatch.from_arrays([pa.array([width] * int(found.sum()), pa.int32()), *[pa.array(x[found]) for x in (ids, similarity, nearest, ords)]], ["width", "id", "similarity", "nearest_id", "nearest_ord"])

    schema = "width int, id long, similarity double, nearest_id long, nearest_ord long"
    return _meet(queries, references, blocks, run, schema).groupBy("width", "id").agg(F.max(F.struct("similarity", (-F.col("nearest_ord")).alias("o"), "nearest_id")).alias("m"))


def _improve(top: list[np.ndarray], similarity: np.ndarray, ords: np.ndarray, ids: np.ndarray) -> None:
    """What is better than top (similarity, ord, id) takes its place; of ties the least ord, then the greatest id."""
    first = (ords < top[1]) | ((ords == top[1]) & (ids > top[2]))
    better = (similarity > top[0]) | ((similarity == top[0]) & first)
    for old, new in zip(top, (similarity, ords, ids), strict=True):
        old[better] = new[better]


def _count_blocks(n: int) -> int:
    return -(-n // BLOCK)


def nearest(queries: DataFrame, references: DataFrame, exclude_self: bool = False, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(id, similarity, nearest_id) for each query; both sides have id, ord and vec (unit length). Ties go to the least ord; no reference gives -1.

    sizes are the numbers of both sides, counted where they aren't given."""
    q, r = sizes or (queries.count(), references.count())
    left = packed(queries, q)
    right = left if queries is references else packed(references, r)
    return _nearest(queries, _best(left, right, _count_blocks(r), exclude_self=exclude_self))


def _nearest(queries: DataFrame, best: DataFrame) -> DataFrame:
    return queries.select("id").join(best, "id", "left").select("id", F.coalesce("m.similarity", F.lit(-1.0)).alias("similarity"), F.col("m.nearest_id").alias("nearest_id"))


def nearest_by_width(queries: DataFrame, references: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(width, id, similarity, nearest_id): nearest() by the first so many dimensions of vectors, for several widths in one pass."""
    q, r = queries.count(), references.count()
    return _best(packed(queries, q), packed(references, r), _count_blocks(r), widths).select("width", "id", "m.similarity", "m.nearest_id")


def nearest_other(vectors: DataFrame) -> DataFrame:
    """nearest() of each row among the others; fewer than two rows is an error."""
    n = vectors.count()
    if n < 2:
        raise ValueError("a row needs another one to be near to")
    return nearest(vectors, vectors, exclude_self=True, sizes=(n, n))


def links(vectors: DataFrame, threshold: float, size: int | None = None) -> DataFrame:
    """(early, late, similarity) of the pairs at or above the threshold; early comes first by ord.

    Rows are dealt to their nearest pivot, and each pivot's rows to blocks. Two pivots' blocks meet only if their angle, less
    both radii, leaves room for the threshold, so what is far apart is never compared; each pair of blocks meets once.
    The pivots are a bounded sample and decide only who meets: no pair at the threshold is lost.
    """
    n = vectors.count() if size is None else size
    pivots = vectors.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // BLOCK))).select("vec").collect()
    if not pivots:
        return vectors.select(F.col("id").alias("early"), F.col("id").alias("late"), F.lit(0.0).alias("similarity")).where("false")
    sent = vectors.sparkSession.sparkContext.broadcast(np.array([p.vec for p in pivots]))

    def nearest_pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                dots = np.stack(frame["vec"].to_numpy()) @ sent.value.T
                yield frame.assign(pivot=dots.argmax(1).astype("int32"), angle=np.arccos(np.clip(dots.max(1), -1, 1)))

    dealt = vectors.select("id", "ord", "vec").mapInPandas(nearest_pivot, "id long, ord long, vec array<double>, pivot int, angle double")
    stats = {r.pivot: (r.n, r.radius) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    return _pruned(dealt, stats, sent.value, threshold)


def _pruned(dealt: DataFrame, stats: dict[int, tuple[int, float]], pivots: np.ndarray, threshold: float) -> DataFrame:
    """links() of rows with their pivot; stats: rows and radius of each pivot."""
    spark, reach = dealt.sparkSession, math.acos(min(1.0, max(-1.0, threshold))) + SLACK
    angles = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    blocks = {p: -(-n // BLOCK) for p, (n, _) in stats.items()}
    near = [(int(a), int(b), blocks[a], blocks[b]) for a in stats for b in stats if a <= b and angles[a, b] - stats[a][1] - stats[b][1] <= reach]
    tasks = spark.createDataFrame(near, "a int, b int, na int, nb int")
    tasks = tasks.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "nb").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j")).where("a < b OR i <= j")
    counts = spark.createDataFrame(list(blocks.items()), "pivot int, blocks int")
    placed = dealt.join(F.broadcast(counts), "pivot").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "angle")
    # A block is sent to the tasks it takes part in, once to each: on the left, or on the right of another.
    left = placed.join(tasks, (F.col("pivot") == F.col("a")) & (F.col("block") == F.col("i"))).withColumn("side", F.lit(0))
    right = placed.join(tasks.where("a < b OR i < j"), (F.col("pivot") == F.col("b")) & (F.col("block") == F.col("j"))).withColumn("side", F.lit(1))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        one, other = frame[frame["side"] == 0], frame[frame["side"] == 1]
        other = other if len(other) else one
        if not len(one):
            return pd.DataFrame(columns=["early", "late", "similarity"])
        a, b, found = one["ord"].to_numpy()[:, None], other["ord"].to_numpy()[None, :], []
        for at, s in _tiles(np.stack(one["vec"].to_numpy()), np.stack(other["vec"].to_numpy())):
            rows = a[at : at + len(s)]
            i, j = np.nonzero((s >= threshold) & ((rows < b) if other is one else (rows != b)))
            found.append((i + at, j, s[i, j]))
        x, y, s = (np.concatenate(c) for c in zip(*found, strict=True))
        first = one["ord"].to_numpy()[x] < other["ord"].to_numpy()[y]
        p, q = one["id"].to_numpy()[x], other["id"].to_numpy()[y]
        return pd.DataFrame({"early": np.where(first, p, q), "late": np.where(first, q, p), "similarity": s})

    both = left.unionByName(right).select("a", "b", "i", "j", "side", "id", "ord", "vec")
    return both.groupBy("a", "b", "i", "j").applyInPandas(meet, "early long, late long, similarity double")


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, ord, vec) of the first row of each set of equal vectors, and (id, ord, first) of all rows: whose set they are in."""
    sets = vectors.groupBy("vec").agg(F.min(F.struct("ord", "id")).alias("m"), F.count("*").alias("n"))
    firsts = sets.select("m.id", "m.ord", "vec", "n")
    repeated = kept(firsts.where("n > 1").select(F.col("id").alias("first"), "vec"))
    bytes_ = repeated.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("n")).first().n * 8
    if not bytes_:
        return vectors.select("id", "ord", "vec"), vectors.select("id", "ord", F.col("id").alias("first"))
    if bytes_ <= FEW_BYTES:
        met = vectors.join(F.broadcast(repeated), "vec", "left")
    else:  # a vector that very many rows have is in many parts
        parts = repeated.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(parts, ["vec", "part"], "left")
    return firsts.drop("n"), met.select("id", "ord", F.coalesce("first", "id").alias("first"))


def decisions(candidates: DataFrame, seeds: DataFrame, evaluation: DataFrame, limits: Thresholds, keep) -> DataFrame:
    """For each candidate: passed, reject_reason, max_prior, max_seed, max_eval, nearest_eval_id.

    A row passes if it is below the duplicate limit against all rows that passed before it (by ord)
    and is neither too close to a seed nor an outlier nor near an evaluation row. Reasons have that
    order. Rounds settle all rows whose earlier neighbours are settled, which is what a pass in
    order would decide; the number of rounds is the longest chain of near duplicates that hangs
    together, and each round is a join over links only.

    Of equal vectors only the first can pass, and all have the same neighbours, so only firsts are compared: however often a
    vector is repeated, its rows only look up what is known of it.

    keep(df, name) writes a table where executors can read it again, and returns it.
    """
    firsts, members = classes(candidates)
    firsts, members = keep(firsts, "firsts"), keep(members, "members")
    n, ns, ne = (df.count() for df in (firsts, seeds, evaluation))
    blocks = packed(firsts, n)
    near_seed = _nearest(firsts, _best(blocks, packed(seeds, ns), _count_blocks(ns))).select("id", F.col("similarity").alias("max_seed"))
    near_eval = _nearest(firsts, _best(blocks, packed(evaluation, ne), _count_blocks(ne))).select("id", F.col("similarity").alias("max_eval"), F.col("nearest_id").alias("nearest_eval_id"))
    scored = keep(firsts.select("id", "ord").join(near_seed, "id").join(near_eval, "id"), "scored")
    good = (F.col("max_seed") < limits.too_close) & (F.col("max_seed") > limits.outlier) & (F.col("max_eval") < limits.contamination)
    eligible = scored.where(good).select("id")
    near = links(firsts.join(eligible, "id", "left_semi"), limits.duplicate, n)
    edges = keep(near.select("early", "late"), "edges")
    accepted = _accepted(eligible, edges, keep)
    taken = accepted.count()
    steps = _prior_steps(blocks, packed(firsts.join(accepted, "id", "left_semi"), taken), _count_blocks(taken))
    known = scored.join(steps, "id", "left").withColumnRenamed("id", "first").drop("ord")
    before = F.filter("steps", lambda s: s["ord"] < F.col("ord"))
    out = members.join(known, "first").withColumn("max_prior", F.coalesce(F.array_max(F.transform(before, lambda s: s["similarity"])), F.lit(-1.0)))
    reason = (
        F.when(F.col("max_prior") >= limits.duplicate, "F5_DUP_SYNTHETIC")
        .when(F.col("max_seed") >= limits.too_close, "F5_DUP_SEED")
        .when(F.col("max_seed") <= limits.outlier, "F5_OUTLIER_SEED")
        .when(F.col("max_eval") >= limits.contamination, "F6_CONTAM_EVAL")
    )
    return out.select("id", "max_prior", "max_seed", "max_eval", "nearest_eval_id", reason.alias("reject_reason")).withColumn("passed", F.col("reject_reason").isNull())


def _accepted(eligible: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """(id) of the rows that a pass in order takes: those none of whose earlier neighbours was taken. ROUNDS rounds are planned before one is written."""
    state = eligible.withColumn("state", F.lit(None).cast("boolean"))
    while True:
        for _ in range(ROUNDS):
            before = edges.join(state.select(F.col("id").alias("early"), F.col("state").alias("early_state")), "early")
            seen = before.groupBy(F.col("late").alias("id")).agg(F.bool_or("early_state").alias("hit"), F.count_if(F.col("early_state").isNull()).alias("open"))
            settled = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
            state = state.join(seen, "id", "left").select("id", settled.alias("state"))
        state = keep(state, "state")
        if not state.where("state IS NULL").limit(1).count():
            return state.where("state").select("id")


def _prior_steps(firsts: DataFrame, accepted: DataFrame, blocks: int) -> DataFrame:
    """(id, steps) of each vector: the accepted rows (ord, similarity) that are nearer than all accepted before them in their share. What is
    nearest before any place is the best of the steps before it. Both tables are packed()."""

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids, steps = None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for (ids, _, vecs), (_, ords, others) in pairs:
            met = [steps]
            for at, s in _tiles(vecs, others):
                top = np.maximum.accumulate(s, axis=1)
                x, y = np.nonzero(np.concatenate([np.ones((len(s), 1), dtype=bool), top[:, 1:] > top[:, :-1]], axis=1))
                met.append((x + at, ords[y], s[x, y]))
            steps = _rising(*(np.concatenate(c) for c in zip(*met, strict=True)))
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[steps[0]]), pa.array(steps[1]), pa.array(steps[2])], ["id", "ord", "similarity"])

    found = _meet(firsts, accepted, blocks, run, "id long, ord long, similarity double")
    return found.groupBy("id").agg(F.collect_list(F.struct("ord", "similarity")).alias("steps"))


def _rising(rows: np.ndarray, ords: np.ndarray, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's steps those that are nearer than all with a lesser ord."""
    order = np.lexsort((-similarity, ords, rows))
    rows, ords, similarity = rows[order], ords[order], similarity[order]
    # Rows lie 4 apart, more than similarities do, so one running maximum serves all; similarities are rounded to far more than its error.
    height = np.maximum.accumulate(similarity + 4.0 * rows)
    up = np.ones(len(rows), dtype=bool)
    up[1:] = similarity[1:] + 4.0 * rows[1:] > height[:-1] + 5e-10
    return rows[up], ords[up], similarity[up]


def exclusions(decided: DataFrame, split: Column) -> DataFrame:
    """The log of contaminated rows: exactly sample_id, similarity, matched_eval_id, split (validation or test)."""
    rows = decided.where("reject_reason = 'F6_CONTAM_EVAL'").select(F.col("id").alias("sample_id"), F.col("max_eval").alias("similarity"), F.col("nearest_eval_id").alias("matched_eval_id"), split.alias("split"))
    return rows.where(F.assert_true(F.col("split").isin("validation", "test"), F.lit("unknown split")).isNull())


def unioned(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of parts; ids that occur twice are an error when it runs."""
    rows = reduce(DataFrame.unionByName, parts)
    twice = rows.groupBy(key).count().agg(F.max("count").alias("_most"))
    return rows.join(F.broadcast(twice)).where(F.assert_true(F.coalesce("_most", F.lit(1)) == 1, F.lit("an id occurs twice")).isNull()).drop("_most")
