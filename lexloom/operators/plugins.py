"""What a user can put in: callables that turn batches of texts into vectors or texts, and filters by name.

A callable is sent to the tasks once and called with lists of texts; a model it needs is loaded by its `open`, once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: open() gives the function that is called with a list of texts.
Backend = Callable[[], Callable[[list[str]], list]]


def encoded(rows: DataFrame, text: str, backend: Backend, name: str = "vec", kind: str = "array<float>") -> DataFrame:
    """rows with what the backend makes of each text (vectors, or translations with kind "string"); null texts stay null, and a wrong number of results is an error."""

    @F.pandas_udf(kind)
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = backend()
        for part in parts:
            given = part.notna().to_numpy()
            made = run(part[given].tolist()) if given.any() else []
            if len(made) != given.sum():
                raise ValueError(f"{len(made)} results for {given.sum()} texts")
            results = iter(made)
            yield pd.Series([next(results) if there else None for there in given])

    return rows.withColumn(name, call(text))


class Filters:
    """Named reasons: each is a column that is null for good rows, and the first that isn't gives a row its reason, in the order in which they were put in."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[[], Column]] = {}

    def add(self, name: str, reason: Callable[[], Column]) -> Filters:
        if name in self._known:
            raise ValueError(f"a filter {name} is there already")
        self._known[name] = reason
        return self

    def names(self) -> list[str]:
        return list(self._known)

    def applied(self, rows: DataFrame, *names: str) -> DataFrame:
        """rows with filter (whose reason it is) and reject_reason; names choose and order the filters."""
        if unknown := [n for n in names if n not in self._known]:
            raise ValueError(f"no filter {', '.join(unknown)}")
        chosen = names or tuple(self._known)
        if not chosen:
            return rows.withColumns({"filter": F.lit(None).cast("string"), "reject_reason": F.lit(None).cast("string")})
        found = F.coalesce(*[F.when(self._known[n]().isNotNull(), F.struct(F.lit(n).alias("n"), self._known[n]().alias("r"))) for n in chosen])
        return rows.withColumn("_found", found).withColumns({"filter": F.col("_found.n"), "reject_reason": F.col("_found.r")}).drop("_found")
