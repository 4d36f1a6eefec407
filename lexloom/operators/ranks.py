"""Places in a total order and digests over it, in which no task sees more than a range of the rows.

A window over a whole table, or over one large group of it, is one task. Here rows are dealt by ranges of
the order, counted per range, and the counts before a range are added to the places in it. The order
must be total: it ends in a key that no two rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.sources.tables import kept

#: How many digests are put together at a time.
FAN = 1024
#: monotonically_increasing_id() has the partition above this bit and the place in it below.
_PLACE_BITS = 33


def ranked(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 1) -> DataFrame:
    """df with each row's place in the order, from start on. The rows are written once, as a second sampling of ranges could cut them otherwise."""
    columns = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = kept(ranged).withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    heads = placed.groupBy("_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = heads.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_range").select(*columns, (F.col("_place") + F.col("_shift")).alias(name))


def ranked_within(df: DataFrame, group: str, *order: Column | str, name: str = "rank", start: int = 1, size: str | None = None) -> DataFrame:
    """df with each row's place in its group's order, and the group's size where a name for it is given; a group may lie in many tasks."""
    rows = ranked(df, F.asc_nulls_first(group), *order, name="_at")
    firsts = rows.groupBy(F.struct(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    met = rows.withColumn("_group", F.struct(group)).join(firsts, "_group")
    sized = [F.col("_size").alias(size)] if size else []
    return met.select(*df.columns, (F.col("_at") - F.col("_first") + start).alias(name), *sized)


def tree_digest(df: DataFrame, value: Column, *order: Column | str, group: str | None = None) -> DataFrame:
    """([group,] n, digest): of rows in order the digests, of FAN of these in turn the digest, and so on until one is left.

    A row's digest is the SHA-256 of its value; a node's that of its children's, joined by line feeds. The digest
    doesn't depend on partitions, and no task has more than FAN digests of a node. A group's single row has its own digest.
    """
    by = group or "_all"
    rows = df if group else df.withColumn("_all", F.lit(0))
    level = ranked_within(rows.withColumn("_digest", F.sha2(value, 256)), by, *order, name="_at", start=0, size="_n").select(by, "_at", "_n", "_digest")
    nodes = F.col("_n")
    most = level.agg(F.max("_n").alias("n")).first().n or 0
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("_at", "_digest")))
        joined = F.sha2(F.array_join(F.transform(children, lambda c: c["_digest"]), "\n"), 256)
        # A group that has come to its root keeps it while others go on.
        digest = F.when(nodes > 1, joined).otherwise(F.first("_digest"))
        level = level.groupBy(by, F.floor(F.col("_at") / FAN).alias("_at"), "_n").agg(digest.alias("_digest"))
        nodes = F.ceil(nodes / FAN)
        most = -(-most // FAN)
    return level.select(*([group] if group else []), F.col("_n").alias("n"), F.col("_digest").alias("digest"))
