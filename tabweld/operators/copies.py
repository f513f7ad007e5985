"""One-to-one assignment where many rows look alike.

Rows of a side that are compared by equal values form a class. Pairs are found and
scored once per pair of classes, never per pair of rows, so a group of copies that
holds a third of a table costs as much as one row until its matches are written out.

The result is that of the greedy pass over the pairs of rows in falling order of
(score, left_id, right_id): rows of a class leave it from the highest position down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.operators.assign import EDGES
from tabweld.operators.row_index import rank_descending
from tabweld.session import materialize, side_by_side

_LOWEST = -(1 << 63)


def classes(side: DataFrame, row_id: str) -> DataFrame:
    """One row per distinct form of a prepared side, under its highest row position."""
    form = [c for c in side.columns if c != row_id]
    return side.groupBy(*form).agg(F.max(row_id).alias(row_id)).select(*side.columns)


def members(side: DataFrame, forms: DataFrame, row_id: str) -> DataFrame:
    """``class, id`` of every row; ``class`` is the row position its class goes by."""
    a, b = side.alias("a"), forms.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in side.columns if c != row_id]
    return a.join(b, reduce(lambda p, q: p & q, same)).select(
        F.col(f"b.{row_id}").alias("class"), F.col(f"a.{row_id}").alias("id")
    )


def _merge_twins(edges: DataFrame, rows: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Join classes with the same partners at the same scores, told by two 64-bit hash sums.

    Only the leader's edges are kept: the classes then act as one.
    """
    link = [F.xxhash64(other, "score", F.lit(salt)).cast("decimal(38,0)") for salt in (1, 2)]
    marks = ["partners", "sum_1", "sum_2"]
    known = edges.groupBy(side).agg(
        F.count(F.lit(1)).alias(marks[0]), F.sum(link[0]).alias(marks[1]), F.sum(link[1]).alias(marks[2])
    )
    leaders = known.groupBy(*marks).agg(F.max(side).alias("leader"))
    led = materialize(known.join(leaders, marks).select(side, "leader"), "twins")
    kept = edges.join(led.filter(F.col(side) == F.col("leader")).select(side), side)
    moved = rows.join(led.withColumnRenamed(side, "class"), "class").select(F.col("leader").alias("class"), "id")
    return materialize(kept.select(*EDGES), "class-edges"), moved


def assign_classes(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Greedy pass over rows, given scored pairs of classes and the members of the classes.

    In each round the best pair of classes of both its classes is taken, for as many rows
    as it stays the best: until one class is used up or, among pairs of equal score, until
    another class holds the higher row.
    """
    edges = materialize(edges.select(*EDGES), "class-edges")
    edges, right = _merge_twins(edges, right, "right_id", "left_id")
    edges, left = _merge_twins(edges, left, "left_id", "right_id")
    ranked = side_by_side(
        lambda: materialize(rank_descending(left, "class", "id"), "left-members"),
        lambda: materialize(rank_descending(right, "class", "id"), "right-members"),
    )
    rows = dict(zip(("left", "right"), ranked))
    used = {side: df.groupBy("class").agg(F.lit(0).cast("bigint").alias("used")) for side, df in rows.items()}
    found = []
    while True:
        tops = {
            side: rows[side]
            .join(used[side], "class")
            .filter(F.col("rank") == F.col("used") + 1)
            .select(F.col("class").alias(f"{side}_id"), F.col("id").alias(f"{side}_top"), F.col("used").alias(f"{side}_used"))
            for side in rows
        }
        open_edges = materialize(edges.join(tops["left"], "left_id").join(tops["right"], "right_id"), "open")
        if open_edges.isEmpty():
            return materialize(reduce(DataFrame.unionByName, found), "pairs") if found else edges.limit(0)
        best, rivals = {}, {}
        for side, other in (("left", "right"), ("right", "left")):
            top = F.max(F.struct("score", f"{other}_top", f"{other}_id")).alias("best")
            best[side] = open_edges.groupBy(f"{side}_id").agg(top)
            ties = open_edges.join(best[side], f"{side}_id").filter(
                (F.col("score") == F.col("best.score")) & (F.col(f"{other}_id") != F.col(f"best.{other}_id"))
            )
            rivals[side] = ties.groupBy(f"{side}_id").agg(F.max(f"{other}_top").alias(f"{other}_rival"))
        mutual = best["left"].select("left_id", F.col("best.right_id").alias("right_id")).join(
            best["right"].select("right_id", F.col("best.left_id").alias("left_id")), ["left_id", "right_id"]
        )
        mutual = open_edges.join(mutual, ["left_id", "right_id"])
        for side in ("left", "right"):
            mutual = mutual.join(rivals[side], f"{side}_id", "left")
        mutual = materialize(mutual, "mutual")
        taken = mutual
        for side in ("left", "right"):
            bound = mutual.select(F.col(f"{side}_id").alias("class"), F.coalesce(f"{side}_rival", F.lit(_LOWEST)).alias("rival"))
            above = rows[side].join(bound, "class").filter(F.col("id") > F.col("rival"))
            reach = above.groupBy(F.col("class").alias(f"{side}_id")).agg(F.max("rank").alias(f"{side}_reach"))
            taken = taken.join(reach, f"{side}_id")
        run = F.least(F.col("left_reach") - F.col("left_used"), F.col("right_reach") - F.col("right_used"))
        taken = materialize(taken.select(*EDGES, "left_used", "right_used", run.alias("run")), "taken")

        halves = {}
        for side in ("left", "right"):
            place = F.col("rank") - F.col(f"{side}_used")
            halves[side] = (
                rows[side]
                .withColumnRenamed("class", f"{side}_id")
                .join(taken, f"{side}_id")
                .filter((place > 0) & (place <= F.col("run")))
                .select(F.col("left_id").alias("pair"), place.alias("place"), F.col("id").alias(f"{side}_row"), "score")
            )
            step = taken.select(F.col(f"{side}_id").alias("class"), "run")
            used[side] = materialize(
                used[side].join(step, "class", "left").select("class", (F.col("used") + F.coalesce("run", F.lit(0))).alias("used")),
                "used",
            )
        pairs = halves["left"].join(halves["right"].drop("score"), ["pair", "place"])
        found.append(
            materialize(pairs.select(F.col("left_row").alias("left_id"), F.col("right_row").alias("right_id"), "score"), "found")
        )
