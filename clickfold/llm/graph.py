"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; a component is named by its smallest node.

    Each round first hangs every node's larger neighbours on its smallest neighbour, then every
    node and its smaller neighbours on the smallest of them, until nothing changes: a number of
    rounds that grows with the logarithm of the graph. Minima combine before the shuffle and the
    star of a node with many neighbours is a join, which Spark splits; no neighbour list is built.
    Each round is written to the shared checkpoint folder, so a lost executor costs one round.
    Links with a NULL end, loops and repeated links are ignored.
    """
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = stored(edges, "links")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        # Large star: from both directions; every larger neighbour is linked to the smallest.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct())
        # Small star: a node's smaller neighbours and itself are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(low.select("u", F.col("low").alias("v"))).where("u != v").distinct())
        changed = stored(small, "links")
        same = changed.count() == edges.count() and changed.exceptAll(edges).isEmpty()
        edges = changed
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
