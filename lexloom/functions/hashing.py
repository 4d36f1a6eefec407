"""Identifiers and orders made from content, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_hash(seed: int, key: Column, namespace: str | None = None) -> Column:
    """An order that depends on nothing but seed, namespace and key."""
    parts = [F.lit(str(seed)), *([F.lit(namespace)] if namespace else []), key.cast("string")]
    return F.sha2(F.concat_ws(":", *parts), 256)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(20)))


def pair_id(*ids: Column) -> Column:
    return F.concat(F.lit("pair_"), F.left(F.sha2(F.concat_ws("\0", *ids), 256), F.lit(16)))
