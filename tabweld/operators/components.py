"""Connected components of pairs, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.session import materialize


def connected_components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) of all nodes of ``pairs`` (``a``, ``b``).

    Each step is a minimum for each node, joined back to its edges: minima combine map-side, and the
    joins of written tables can be split where a node has very many edges. The number of steps
    grows with the logarithm of the nodes.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "component-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy(F.col("a").alias("u")).agg(F.least("u", F.min("b")).alias("m")), "lowest")
        large = both.join(lowest, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        lowest = materialize(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "lowest")
        near = large.join(lowest, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(near.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        # Done when nothing moves: every node's only lower neighbour is its root.
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = small
