"""Hierarchical paired bootstrap: seeds are drawn, then rows within each, and metric deltas averaged.

For accuracy alone:

A seed's rows are told apart by their two hits only, so a seed is four counts at most, and rows drawn from it
are a multinomial draw from these. A hit that is null counts as 0. Replicates are dealt to tasks, each with a random stream of its own (replicate number and seed), so results don't depend on the
number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ranks import ranked_within
from lexloom.operators.scoring import macro_f1
from lexloom.sources.tables import kept

COLUMNS = ["seed", "base_hit", "new_hit"]
#: Of a row, for either model: its label, whether it is read and exact, and what its slots give.
PARTS = ("predicted", "valid", "exact", "tp", "fp", "fn")
METRICS = ("intent_accuracy", "intent_macro_f1", "slot_micro_f1", "exact_match", "json_valid_rate")
#: Cells of a seed in a block, and replicates a task draws at a time.
CELLS, SLICE = 4096, 100


def deltas(pairs: DataFrame, replicates: int, random_seed: int = 20260729) -> DataFrame:
    """(replicate, delta) of accuracy; pairs: seed, base_hit, new_hit (0 or 1) per row."""
    spark = pairs.sparkSession
    hits = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in COLUMNS[1:]]
    counts = pairs.where("seed IS NOT NULL").select("seed", *hits).groupBy(*COLUMNS).count()
    frame = counts.toPandas().sort_values(COLUMNS)  # four rows a seed at most
    groups = [((g["new_hit"] - g["base_hit"]).to_numpy(), g["count"].to_numpy()) for _, g in frame.groupby("seed", sort=True)]
    sent = spark.sparkContext.broadcast(groups)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = sent.value
        for part in frames:
            out = []
            for k in part["id"]:
                rng = np.random.default_rng([random_seed, int(k)])
                drawn = [data[i] for i in rng.integers(0, len(data), len(data))]
                out.append(np.mean([rng.multinomial(n.sum(), n / n.sum()) @ change / n.sum() for change, n in drawn]))
            yield pd.DataFrame({"replicate": part["id"], "delta": out})

    return spark.range(replicates).mapInPandas(run, "replicate long, delta double")


def interval(draws: DataFrame) -> DataFrame:
    """One row: mean delta and its 95 % interval."""
    low, high = F.percentile("delta", 0.025), F.percentile("delta", 0.975)
    return draws.agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean_delta"), low.alias("low"), high.alias("high"))


# --- All metrics ------------------------------------------------------------------------------------
#
# Rows of a seed that agree in all their parts are one cell with a count, and drawing rows is a multinomial
# draw over cells. Cells are dealt to blocks: how many of a replicate's rows fall into each block is a draw over the
# blocks' counts, which all tasks make alike, and a block's task draws among its own cells. Blocks' sums
# are added before a metric is taken, so the split changes nothing in the distribution, and no task or driver has
# more than a block of cells and one count per block.


def cells(pairs: DataFrame) -> DataFrame:
    """Distinct rows with their count n. pairs: seed, expected, and base_ and new_ for each of PARTS; predicted is null where an answer can't be read."""
    keys = ["seed", "expected", *[f"{m}_{p}" for m in ("base", "new") for p in PARTS]]
    return pairs.where("seed IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))


def metric_deltas(pairs: DataFrame, labels: DataFrame, replicates: int, random_seed: int = 20260729) -> DataFrame:
    """(replicate, metric, delta), new less base, averaged over the seeds drawn. labels (label) is the catalogue over which macro-F1 goes; it is small.

    Labels outside of the catalogue count for accuracy only. Empty pairs give no rows.
    """
    spark = pairs.sparkSession
    found = kept(ranked_within(cells(pairs), "seed", *_order(), name="_at", start=0).withColumn("block", F.floor(F.col("_at") / CELLS).cast("int")))
    counts = found.groupBy("seed", "block").agg(F.sum("n").alias("n")).orderBy("seed", "block").collect()  # one row a block
    if not counts:
        return spark.createDataFrame([], "replicate long, metric string, delta double")
    seeds = sorted({r.seed for r in counts})
    catalogue = sorted(r.label for r in labels.select("label").distinct().collect())
    sizes = {s: np.array([r.n for r in counts if r.seed == s]) for s in seeds}
    slices = -(-replicates // SLICE)
    # Few bytes, much work: dealt to tasks by number.
    dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).drop("_at").repartition(min(len(counts) * slices, 2000), "seed", "block", "slice")
    sent = spark.sparkContext.broadcast((seeds, sizes, catalogue))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        seeds, sizes, catalogue = sent.value
        seed, block, part = frame["seed"].iloc[0], int(frame["block"].iloc[0]), int(frame["slice"].iloc[0])
        frame = frame.sort_values([c for c in frame.columns if c not in ("slice", "block")], na_position="first", kind="stable")
        matrix, n = _components(frame, catalogue), frame["n"].to_numpy()
        out = []
        for replicate in range(part * SLICE, min(replicates, (part + 1) * SLICE)):
            chosen = np.random.default_rng([random_seed, replicate]).integers(0, len(seeds), len(seeds))
            for turn in np.flatnonzero(chosen == seeds.index(seed)):
                total = sizes[seed]
                share = np.random.default_rng([random_seed, replicate, int(turn), 0]).multinomial(total.sum(), total / total.sum())[block]
                drawn = np.random.default_rng([random_seed, replicate, int(turn), 1 + block]).multinomial(share, n / n.sum())
                out.append((replicate, int(turn), (drawn @ matrix).tolist()))
        return pd.DataFrame(out, columns=["replicate", "turn", "sums"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        size, by_turn = len(sent.value[2]), frame.groupby("turn", sort=True)["sums"]
        each = [_metrics(np.sum(np.stack(sums.to_numpy()), axis=0), size) for _, sums in by_turn]
        delta = np.mean([m["new"] - m["base"] for m in each], axis=0)
        return pd.DataFrame({"replicate": frame["replicate"].iloc[0], "metric": METRICS, "delta": delta})

    drawn = dealt.groupBy("seed", "block", "slice").applyInPandas(draw, "replicate long, turn int, sums array<bigint>")
    return drawn.groupBy("replicate").applyInPandas(finish, "replicate long, metric string, delta double")


def _order() -> list:
    return [F.asc_nulls_first(c) for c in ("expected", *[f"{m}_{p}" for m in ("base", "new") for p in PARTS])]


def _components(frame: pd.DataFrame, catalogue: list[str]) -> np.ndarray:
    """Per cell what is summed: n; expected by label; and per model predicted and right by label, hits, exact, valid, tp, fp, fn."""
    at = {label: k for k, label in enumerate(catalogue)}
    rows, size = len(frame), len(catalogue)

    def one_hot(values) -> np.ndarray:
        out = np.zeros((rows, size), dtype=np.int64)
        for k, value in enumerate(values):
            if value in at:
                out[k, at[value]] = 1
        return out

    expected = frame["expected"].to_numpy(dtype=object)
    parts = [np.ones((rows, 1), dtype=np.int64), one_hot(expected)]
    for model in ("base", "new"):
        predicted = frame[f"{model}_predicted"].to_numpy(dtype=object)
        right = np.array([p is not None and p == e for p, e in zip(predicted, expected, strict=True)])
        numbers = [right, *[frame[f"{model}_{p}"].fillna(0).astype(np.int64).to_numpy() for p in ("exact", "valid", "tp", "fp", "fn")]]
        parts += [one_hot(predicted), one_hot(predicted) * right[:, None], np.stack([np.asarray(x, dtype=np.int64) for x in numbers], axis=1)]
    return np.concatenate(parts, axis=1)


def _metrics(sums: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The metrics of both models, in the order of METRICS, from the sums of _components()."""
    n, expected, rest, out = sums[0], sums[1 : 1 + size], sums[1 + size :], {}
    for model, part in (("base", rest[: 2 * size + 6]), ("new", rest[2 * size + 6 :])):
        predicted, right, (hits, exact, valid, tp, fp, fn) = part[:size], part[size : 2 * size], part[2 * size :]
        both = expected + predicted
        macro = np.mean(np.where(both > 0, 2 * right / np.maximum(both, 1), 0.0)) if size else 0.0
        out[model] = np.array([hits / n, macro, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0, exact / n, valid / n])
    return out


def point_deltas(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(seed, metric, delta) of the rows as they are, by built-in functions."""
    long = []
    for model in ("base", "new"):
        rows = pairs.select("seed", "expected", *[F.col(f"{model}_{p}").alias(p) for p in PARTS])
        hit = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)).cast("double")
        tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
        slots = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(1.0))
        flags = rows.groupBy("seed").agg(F.avg(hit).alias("intent_accuracy"), slots.alias("slot_micro_f1"), *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(m) for c, m in (("exact", "exact_match"), ("valid", "json_valid_rate"))])
        macro = macro_f1(rows, labels, "seed").select("seed", F.col("macro_f1").alias("intent_macro_f1"))
        long.append(flags.join(macro, "seed").unpivot("seed", list(METRICS), "metric", model))
    return long[0].join(long[1], ["seed", "metric"]).select("seed", "metric", (F.col("new") - F.col("base")).alias("delta"))


def intervals(draws: DataFrame) -> DataFrame:
    """(metric, replicates, low, high): the middle 95 % of metric_deltas()."""
    low, high = F.percentile("delta", 0.025), F.percentile("delta", 0.975)
    return draws.groupBy("metric").agg(F.count("*").alias("replicates"), low.alias("low"), high.alias("high"))
