"""Matching rows that must agree on all their identifiers.

Each distinct identifier is a group. Every passing pair in it has equal identifiers and
so the same score, 1; the greedy pass then takes, for the highest left row, the highest
right row that passes, and so on down. How a group is worked depends on its size only:

* Both sides of a few rows (``FEW``): compare all its pairs, at most that many per row.
* Both sides short (``SHORT``): the greedy pass in one task, which compares a row with the
  highest rows first and goes on only if none of these passes (``group_pass``).
* Else: in rounds, each comparing a number of pairs linear in the group.
  1. Rank both sides from the top and compare rank with rank. Up to the first pair that
     fails, these are the pairs of the greedy pass: each is the top of what is left.
  2. From there, compare the top ``HEADS`` rows of the shorter side with all rows left
     on the other. Their greedy choices do not depend on the rows below them. At most
     ``HEADS - 1`` partners can be gone to other heads, so a head's top ``HEADS``
     passing partners decide its choice exactly; the rest is not shuffled.

Neither way lists all pairs of a large group, and a group that holds most of the table
is spread over many tasks in every step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabweld.operators.assign import EDGES, greedy_in_groups
from tabweld.operators.candidates import key_counts, keyed, tasks_for
from tabweld.operators.group_pass import match_whole_groups
from tabweld.operators.row_index import rank_descending
from tabweld.operators.scoring import RowScore
from tabweld.session import materialize, side_by_side

FEW = 32
SHORT = 1_024
HEADS = 64
PIECE_ROWS = 20_000


def group_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows per key on each side, for keys on both sides."""
    return key_counts(left, right).filter((F.col("lefts") > 0) & (F.col("rights") > 0))


def match_by_ids(row_score: RowScore, left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched pairs of prepared sides when all identifiers of a pair must be equal."""
    ids = tuple(row_score.indexes("id"))
    left, right = keyed(left, "left", ids), keyed(right, "right", ids)
    found, limit = [], min(FEW, SHORT) if row_score.embed else SHORT
    while True:
        few = limit if row_score.embed else min(FEW, limit)
        sizes = materialize(group_sizes(left, right).filter(_above(few)), "large-groups")
        if sizes.isEmpty():
            found.append(_match_few(row_score, left, right))
            break
        found.append(_match_few(row_score, left.join(sizes, "key", "left_anti"), right.join(sizes, "key", "left_anti")))
        short = sizes.filter(~_above(limit))
        pairs = short.agg(F.sum(F.col("lefts") * F.col("rights"))).first()[0]
        if pairs:
            sides = [df.join(short, "key", "left_semi") for df in (left, right)]
            found.append(materialize(match_whole_groups(row_score, *sides, tasks_for(pairs)), "group-pairs"))
        long = sizes.filter(_above(limit)).select("key")
        if long.isEmpty():
            break
        left, right, more = _match_round(
            row_score, left.join(long, "key", "left_semi"), right.join(long, "key", "left_semi")
        )
        found += more
        if left is None:
            break
        # What is left did not pass rank by rank: up to as many rows as heads, all pairs are due.
        limit = max(limit, HEADS)
    return materialize(reduce(DataFrame.unionByName, found), "pairs")


def _above(rows: int) -> Column:
    return (F.col("lefts") > rows) | (F.col("rights") > rows)


def _match_few(row_score: RowScore, left: DataFrame, right: DataFrame) -> DataFrame:
    edges = row_score.passing(left.join(right, "key"), ids_equal=True).select("key", *EDGES)
    return greedy_in_groups(edges, "key")


def _match_round(row_score: RowScore, left: DataFrame, right: DataFrame):
    """One round on long groups: the rows still open on each side, and the pairs found."""
    left, right = side_by_side(
        lambda: materialize(rank_descending(left, "key", "left_id", "left_rank"), "left-ranked"),
        lambda: materialize(rank_descending(right, "key", "right_id", "right_rank"), "right-ranked"),
    )
    sizes = (
        left.groupBy("key")
        .agg(F.max("left_rank").alias("lefts"))
        .join(right.groupBy("key").agg(F.max("right_rank").alias("rights")), "key")
    )
    level = left.join(right.withColumnRenamed("right_rank", "left_rank"), ["key", "left_rank"])
    passed = materialize(row_score.passing(level, ids_equal=True).select("key", "left_rank", *EDGES), "level")
    compared = left.join(sizes, "key").filter(F.col("left_rank") <= F.least("lefts", "rights"))
    failed = compared.join(passed, ["key", "left_rank"], "left_anti")
    firsts = failed.groupBy("key", "lefts", "rights").agg(F.min("left_rank").alias("fail"))
    firsts = materialize(firsts, "firsts")
    unbroken = passed.join(firsts, "key", "left")
    settled = unbroken.filter(F.col("fail").isNull() | (F.col("left_rank") < F.col("fail"))).select(*EDGES)
    longest = firsts.agg(F.sum(F.greatest("lefts", "rights") - F.col("fail") + 1)).first()[0]
    if longest is None:
        return None, None, [settled]
    left = left.join(firsts, "key").filter(F.col("left_rank") >= F.col("fail"))
    right = right.join(firsts, "key").filter(F.col("right_rank") >= F.col("fail"))
    heads_left, below = F.col("lefts") <= F.col("rights"), F.col("fail") + HEADS
    heads = _settle_heads(row_score, left, right, heads_left, below, tasks_for(longest * HEADS))
    left_open = _drop_settled(left.filter(~heads_left | (F.col("left_rank") >= below)), heads, "left")
    right_open = _drop_settled(right.filter(heads_left | (F.col("right_rank") >= below)), heads, "right")
    left, right = side_by_side(lambda: materialize(left_open, "left-open"), lambda: materialize(right_open, "right-open"))
    return left, right, [settled, heads]


def _drop_settled(rows: DataFrame, heads: DataFrame, side: str) -> DataFrame:
    rows = rows.drop(f"{side}_rank", "lefts", "rights", "fail")
    return rows.join(heads.select(f"{side}_id"), f"{side}_id", "left_anti")


def _settle_heads(
    row_score: RowScore, left: DataFrame, right: DataFrame, heads_left: Column, below: Column, tasks: int
) -> DataFrame:
    """Greedy choices of the top rows of each group's shorter side."""
    extra, on = ["lefts", "rights", "fail"], ["key", "piece"]
    edges = []
    for side, other, chosen in (("left", "right", heads_left), ("right", "left", ~heads_left)):
        rows = {"left": left, "right": right}
        top = rows[side].filter(chosen & (F.col(f"{side}_rank") < below))
        # A group's long side is cut into pieces, and its heads go to each of them.
        pieces = F.ceil(F.greatest("lefts", "rights") / PIECE_ROWS).cast("int")
        top = top.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        others = rows[other].filter(chosen).withColumn("piece", (F.col(f"{other}_rank") % pieces).cast("int"))
        top = top.drop(*extra).repartition(tasks, *on)
        pairs = others.drop(*extra).repartition(tasks, *on).join(top.hint("merge"), on)
        edges.append(top_partners(row_score, pairs, side, other))
    return materialize(greedy_in_groups(edges[0].unionByName(edges[1]), "key"), "heads")


def top_partners(row_score: RowScore, pairs: DataFrame, side: str, other: str) -> DataFrame:
    """The ``HEADS`` highest passing partners of each head; Spark limits them before the shuffle."""
    best = W.partitionBy("key", f"{side}_id").orderBy(F.desc(f"{other}_id"))
    kept = row_score.passing(pairs, ids_equal=True).withColumn("best", F.row_number().over(best))
    return kept.filter(F.col("best") <= HEADS).select("key", *EDGES)
