"""One-to-one assignment: the pairs a greedy pass in falling order would take.

Pairs are ordered by (score, left_id, right_id), all falling, which is a strict order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.operators.components import connected_components
from tabweld.session import materialize

EDGES = ["left_id", "right_id", "score"]
#: Rounds of locally dominant edges before the open edges are folded, and how many a fold takes.
ROUNDS = 8
FOLD_EDGES = 200_000


def take_greedily(edges: Column) -> Column:
    """Greedy pass over one short array of ``struct(score, left_id, right_id)``."""
    ordered = F.sort_array(edges, asc=False)

    def step(taken: Column, edge: Column) -> Column:
        used = F.exists(taken, lambda t: (t["left_id"] == edge["left_id"]) | (t["right_id"] == edge["right_id"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(edge)))

    return F.aggregate(ordered, F.slice(ordered, 1, 1), step)


def greedy_in_groups(edges: DataFrame, group: str) -> DataFrame:
    """Greedy pass in each group of edges; the caller bounds the groups and keeps rows apart."""
    listed = edges.groupBy(group).agg(F.collect_list(F.struct("score", "left_id", "right_id")).alias("edges"))
    taken = listed.select(F.explode(take_greedily(F.col("edges"))).alias("e"))
    return taken.select("e.left_id", "e.right_id", "e.score")


def greedy_assignment(edges: DataFrame) -> DataFrame:
    """Greedy pass over any set of edges, in a bounded number of rounds of locally dominant edges.

    An edge that is the best one of both its rows is taken by the sequential pass too,
    so each round takes all such edges and drops the rows they use. Best edges come from
    aggregates that combine map-side, so a row with very many edges is no hot spot.

    Chains of rising scores leave one edge to a round. So after ``ROUNDS`` rounds, or while they are few, the open edges
    are solved by folds: all in one while they are few, else one for each connected component,
    whose results do not depend on each other. Of a larger component the best ``FOLD_EDGES``
    edges or so, which the pass comes to first, are folded, and the rest goes on.
    """
    found = []
    remaining = materialize(edges.select(*EDGES), "edges")
    for _ in range(ROUNDS):
        if remaining.count() <= FOLD_EDGES:
            break
        best_left = remaining.groupBy("left_id").agg(F.max(F.struct("score", "right_id")).alias("b"))
        best_right = remaining.groupBy("right_id").agg(F.max(F.struct("score", "left_id")).alias("b"))
        taken = best_left.select("left_id", "b.right_id", "b.score").join(
            best_right.select("b.left_id", "right_id"), ["left_id", "right_id"]
        )
        found.append(materialize(taken.select(*EDGES), "taken"))
        remaining = _without(remaining, found[-1])
    while not remaining.isEmpty():
        first = _foldable(remaining)
        found.append(materialize(folded(first), "taken"))
        remaining = _without(remaining.join(first.select(*EDGES), EDGES, "left_anti"), found[-1])
    return reduce(DataFrame.unionByName, found) if found else remaining


def _without(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges whose rows are both free."""
    free = edges.join(taken.select("left_id"), "left_id", "left_anti").join(taken.select("right_id"), "right_id", "left_anti")
    return materialize(free.select(*EDGES), "edges")


def _foldable(edges: DataFrame) -> DataFrame:
    """Edges with a ``part``: whole components, or what the pass over a large one comes to first."""
    if edges.count() <= FOLD_EDGES:
        return edges.withColumn("part", F.lit(0).cast("bigint"))
    # Equal hashes would join components, which does no harm.
    nodes = [F.xxhash64(F.lit(side), f"{side}_id") for side in ("left", "right")]
    roots = connected_components(edges.select(nodes[0].alias("a"), nodes[1].alias("b")))
    placed = edges.withColumn("node", nodes[0]).join(roots, "node").select(*EDGES, F.col("root").alias("part"))
    placed = materialize(placed, "component-edges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    whole = placed.join(sizes.where(F.col("n") <= FOLD_EDGES).select("part"), "part", "left_semi")
    large = placed.join(sizes.where(F.col("n") > FOLD_EDGES), "part")
    if large.isEmpty():
        return whole

    shares = [1 - 2.0**-k for k in range(1, 17)]

    def top(rows: DataFrame, column: str) -> DataFrame:
        """A value of the column that at most about ``FOLD_EDGES`` of a part's ``n`` edges are above, and its largest."""
        halvings = F.ceil(F.log2(F.max("n") / FOLD_EDGES)).cast("int")
        place = F.greatest(F.lit(0), F.least(halvings, F.lit(len(shares))) - 1)
        found = rows.groupBy("part").agg(place.alias("place"), F.percentile_approx(column, shares, 100_000).alias("q"), F.max(column).alias("most"))
        return found.select("part", F.get("q", "place").alias("cut"), "most")

    cuts = materialize(top(large, "score"), "score-cuts")
    above = large.join(cuts, "part").where(F.col("score") > F.col("cut")).select(*EDGES, "part")
    # All of the best share one score: then the pass goes by falling left positions.
    level = cuts.where(F.col("cut") >= F.col("most")).select("part", "most")
    ties = large.join(level, "part").where(F.col("score") == F.col("most")).select(*EDGES, "part")
    ties = materialize(ties.join(ties.groupBy("part").agg(F.count("*").alias("n")), "part"), "ties")
    lefts = materialize(top(ties, "left_id"), "tie-cuts")
    few = ties.join(lefts, "part").where(F.col("left_id") > F.col("cut")).select(*EDGES, "part")
    # All of these have one left row: it takes the highest right one.
    last = ties.join(lefts.where(F.col("cut") >= F.col("most")), "part").where(F.col("left_id") == F.col("most"))
    last = last.groupBy("part").agg(F.max(F.struct("right_id", "left_id", "score")).alias("e")).select("e.left_id", "e.right_id", "e.score", "part")
    return materialize(whole.unionByName(above).unionByName(few).unionByName(last), "foldable")


def folded(edges: DataFrame) -> DataFrame:
    """The sequential pass over each ``part``, in a task of its own."""

    def run(group: pa.Table) -> pa.Table:
        score, left, right = (group[c].to_numpy() for c in ("score", "left_id", "right_id"))
        order = np.lexsort((right, left, score))[::-1]
        used_left, used_right, taken = set(), set(), []
        for i, a, b in zip(order.tolist(), left[order].tolist(), right[order].tolist()):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                taken.append(i)
        return group.select(EDGES).take(pa.array(taken, pa.int64()))

    return edges.select(*EDGES, "part").groupBy("part").applyInArrow(run, edges.select(*EDGES).schema)
