"""Connected components of an edge table by contraction: every round halves the nodes at least, nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Result: node, root (the smallest node of its component), for every node of an edge between different nodes.

    Repeated edges count once, edges from a node to itself and edges with a null end don't count; an empty table gives an
    empty result.

    Each round hangs every node on its smallest neighbour, jumps pointers, and renames the ends of the edges.
    """
    alive = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "cc-edges")
    mapping = None
    while not alive.isEmpty():
        both = alive.union(alive.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("up"))
        parent = materialize(parent, "cc-parent")
        for _ in range(2):
            nxt = parent.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            parent = parent.join(nxt.hint("merge"), F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up"))
        parent = materialize(parent, "cc-parent")
        p = parent.select(F.col("node").alias("_n"), F.col("up").alias("_up")).hint("merge")
        if mapping is None:
            mapping = parent.select("node", F.col("up").alias("root"))
        else:
            known = mapping.join(p, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_up", "root").alias("root"))
            mapping = materialize(known, "cc-map")
        renamed = alive.join(p, F.col("a") == F.col("_n")).select(F.col("_up").alias("a"), "b")
        renamed = renamed.join(p, F.col("b") == F.col("_n")).select("a", F.col("_up").alias("b"))
        alive = materialize(renamed.where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    return mapping if mapping is not None else alive.select(F.col("a").alias("node"), F.col("b").alias("root"))
