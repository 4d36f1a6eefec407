"""Connected components of an undirected graph by alternating star operations.

Each round is a distributed union step: every node is linked to the least node it knows. The large
star links a node's larger neighbours to the least of them all, the small star its smaller ones.
Both keep the components and at least halve the depth of the trees; when no parent has a parent
the edges are (node, least node of its component). Only joins and minima are used: a hub's
neighbours are never gathered, minima are combined before the shuffle, and the join that brings a
hub's minimum back to its edges is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("parent", "node")).toDF("at", "near")
    least = both.groupBy("at").agg(F.min("near").alias("least")).select("at", F.least("at", "least").alias("least"))
    return both.where("near > at").join(least, "at").select(F.col("near").alias("node"), F.col("least").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("node").agg(F.min("parent").alias("least"))
    moved = edges.join(least, "node").where("parent > least").select(F.col("parent").alias("node"), F.col("least").alias("parent"))
    return moved.union(least.select("node", F.col("least").alias("parent"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of edges (two columns of longs); component is the least node.

    Loops and repeated edges don't matter; rows with a null end are no edges; no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("parent"))
    current = written(edges.distinct(), name)
    while True:
        deep = current.join(current.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").limit(1).count()
        several = current.groupBy("node").count().where("count > 1").limit(1).count() if not deep else 1
        if not deep and not several:
            break
        after = written(_small_star(_large_star(current)), name)
        forget(current)
        current = after
    roots = current.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return current.select("node", F.col("parent").alias("component")).union(roots)
