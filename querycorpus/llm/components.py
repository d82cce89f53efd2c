"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them. Edges hold a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b")).distinct()


def local_roots(near: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a small symmetric link matrix."""
    root = np.arange(len(near))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(near)).min(1, initial=len(near)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is its smallest node.

    Null ends and self links are ignored; repeated links do no harm. Each round is two equi-joins and
    map-side combined minima, so a node with many links is never gathered; the edge table never grows.
    Rounds grow with the logarithm of the number of nodes. Lineage is cut by checkpoint() each round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = cut_lineage(edges), None
    for _ in range(max_rounds):
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        edges = cut_lineage(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
