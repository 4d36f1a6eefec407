"""Interval and test formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The two normal quantiles in use, and Student's t for two degrees of freedom.
Z_SIZING, Z_AUDIT = 1.96, 1.959963984540054
T_TWO = 4.302652729696142


def wilson(successes: Column, n: Column, z: float = Z_AUDIT) -> tuple[Column, Column]:
    """Wilson's score interval; null unless 0 <= successes <= n and n > 0."""
    ok = (n > 0) & (successes >= 0) & (successes <= n)
    p = F.try_divide(successes.cast("double"), n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n.cast("double") * n))
    middle, scale = p + F.try_divide(F.lit(z * z / 2), n), 1 + F.try_divide(F.lit(z * z), n)
    return F.when(ok, (middle - spread) / scale), F.when(ok, (middle + spread) / scale)


def holm(p: Column, *partition: str) -> Column:
    """Step-down adjusted p-values within a partition of the rows."""
    order = Window.partitionBy(*partition).orderBy(p)
    m, rank = F.count("*").over(Window.partitionBy(*partition)), F.row_number().over(order)
    return F.max(F.least(F.lit(1.0), (m - rank + 1) * p)).over(order.rowsBetween(Window.unboundedPreceding, 0))


def mcnemar_p(losses: Column, gains: Column) -> Column:
    """Two-sided exact p-value from the discordant counts: twice the lesser tail of a fair binomial, its terms one from the other as logarithms."""
    n, least = (losses + gains).cast("double"), F.least(losses, gains)
    start = F.struct((-n * math.log(2)).alias("term"), F.lit(0.0).alias("sum"))

    def step(state: Column, k: Column) -> Column:
        return F.struct((state["term"] + F.log((n - k) / (k + 1))).alias("term"), (state["sum"] + F.exp(state["term"])).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), least.cast("long")), start, step, lambda s: s["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def t_interval(mean: Column, deviation: Column) -> tuple[Column, Column]:
    """For the mean of three runs."""
    half = T_TWO * deviation / math.sqrt(3)
    return mean - half, mean + half


def gap_closed(value: Column, low: Column, high: Column) -> Column:
    """Percent of the way from low to high, null if they are within 0.01."""
    return F.when(F.abs(high - low) >= 0.01, 100.0 * (value - low) / (high - low))
