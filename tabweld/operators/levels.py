"""One-to-one matches by falling levels of the score.

The greedy pass takes all pairs of a score above a level before any below it. So the level falls in
steps: each finds the pairs that reach it among the rows still free, under the tighter bounds of that
level, and takes them. A row with a good partner is gone before the wide search, whose pairs the pass would
have dropped anyway. The edges of a few rows tell how low a level may be; the result does not depend on it.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.operators import candidates
from tabweld.operators.assign import greedy_assignment
from tabweld.operators.blocks import most_cosine, score_edges
from tabweld.operators.copies import assign_classes
from tabweld.operators.scoring import RowScore
from tabweld.session import materialize, side_by_side

#: A level is to leave about so many edges, and so many for each row of the shorter side.
LEVEL_EDGES = 200_000
ROW_EDGES = 1
#: Rows whose edges tell where that level is.
PROBE_ROWS = 256
PROBE_SHARES = (0.5, 0.25, 0)
SKETCH_ROWS = 10_000
#: A join that leaves this share of all pairs, or more, is no better than comparing blocks.
BAND_SHARE = 0.01
#: So is one that leaves so many pairs for each row, which cells of like rows divide further.
BAND_ROW_PAIRS = 1_000
GRAM_SHARE = 0.01
SAMPLE_ROWS = 2_000


def many_pairs(row_score: RowScore, left: DataFrame, right: DataFrame) -> bool:
    """Whether the joins of ``value_pairs`` leave so many pairs that levels are worth their steps.

    Only decides between two ways to the same result; a sample of rows shows what bigrams leave.
    """
    total = left.count() * right.count()
    if row_score.indexes("id") or row_score.embed or total <= candidates._FEW_PAIRS:
        return False
    band = candidates._band_join(row_score, left, right, True)
    if band is not None and band.pairs <= candidates._FEW_PAIRS:
        return False
    few = [materialize(sampled(df, s), "sample") for df, s in ((left, "left"), (right, "right"))]
    gram = candidates._gram_join(row_score, *few)
    if gram is None:
        return band is not None
    return gram.pairs > GRAM_SHARE * few[0].count() * few[1].count()


def sampled(df: DataFrame, side: str) -> DataFrame:
    return df.orderBy(F.xxhash64(f"{side}_id")).limit(SAMPLE_ROWS)


def match_by_levels(row_score: RowScore, left: DataFrame, right: DataFrame, rows: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Matches of distinct prepared rows, or of the ``rows`` (``class, id``) that look like them."""
    row_score = replace(row_score, most_cosine=most_cosine(left, right))
    allowed, found = 1, []
    while True:
        level = _level(row_score, left, right, allowed)
        edges = _edges(replace(row_score, threshold=level), left, right)
        pairs = greedy_assignment(edges) if rows is None else assign_classes(edges, *rows)
        pairs = materialize(pairs, "level-pairs")
        found.append(pairs)
        if level <= row_score.threshold:
            break
        before = min(left.count(), right.count())
        if not pairs.isEmpty():
            left, right, rows = _free(left, right, rows, pairs)
        if left.isEmpty() or right.isEmpty():
            break
        # A level that settles little is followed by a wider one.
        if min(left.count(), right.count()) > 0.75 * before:
            allowed *= 4
    return materialize(reduce(DataFrame.unionByName, found), "pairs")


def _level(row_score: RowScore, left: DataFrame, right: DataFrame, allowed: int) -> float:
    """The score that about as many pairs reach as a level is to leave, or the threshold."""
    lefts, rights = left.count(), right.count()
    most = allowed * (LEVEL_EDGES + ROW_EDGES * min(lefts, rights))
    if lefts * rights <= most:
        return row_score.threshold
    probe = materialize(left.orderBy(F.xxhash64("left_id")).limit(PROBE_ROWS), "probe")
    wanted = most * probe.count() / lefts
    # The best edges are far fewer than all that pass: these are looked for only where the best do not suffice.
    for share in PROBE_SHARES:
        bound = row_score.threshold + share * (1 - row_score.threshold)
        edges = materialize(score_edges(replace(row_score, threshold=bound), probe, right), "probe-edges")
        found = edges.count()
        if wanted < found:
            break
    else:
        return row_score.threshold
    # A sketch does not tell a few scores at the top of many.
    if wanted <= SKETCH_ROWS:
        level = edges.orderBy(F.desc("score")).limit(max(1, int(wanted))).agg(F.min("score")).first()[0]
    else:
        level = edges.agg(F.percentile_approx("score", 1 - wanted / found, SKETCH_ROWS)).first()[0]
    return max(row_score.threshold, level)


def _edges(row_score: RowScore, left: DataFrame, right: DataFrame) -> DataFrame:
    lefts, rights = left.count(), right.count()
    most = max(candidates._FEW_PAIRS, min(BAND_SHARE * lefts * rights, BAND_ROW_PAIRS * (lefts + rights)))
    if min(lefts, rights) > SAMPLE_ROWS:
        # Counting lists each right row nine times, so a sample tells first whether the bands can be narrow enough.
        few = [materialize(sampled(df, s), "sample") for df, s in ((left, "left"), (right, "right"))]
        band = candidates._band_join(row_score, *few, True)
        if band is None or band.pairs * lefts * rights > 4 * most * few[0].count() * few[1].count():
            return score_edges(row_score, left, right)
    band = candidates._band_join(row_score, left, right, True)
    if band is not None and band.pairs <= most:
        return row_score.passing(band.joined())
    return score_edges(row_score, left, right)


def _free(left: DataFrame, right: DataFrame, rows: tuple[DataFrame, DataFrame] | None, pairs: DataFrame):
    """What the pairs leave on both sides."""
    if rows is None:
        sides = [lambda df=df, s=s: materialize(df.join(pairs.select(f"{s}_id"), f"{s}_id", "left_anti").select(*df.columns), f"{s}-free") for s, df in (("left", left), ("right", right))]
        return *side_by_side(*sides), None
    kept = side_by_side(
        *[lambda df=df, s=s: materialize(df.join(pairs.select(F.col(f"{s}_id").alias("id")), "id", "left_anti").select("class", "id"), f"{s}-rows") for s, df in zip(("left", "right"), rows)]
    )
    sides = [
        lambda df=df, s=s, k=k: materialize(df.join(k.select(F.col("class").alias(f"{s}_id")).distinct(), f"{s}_id", "left_semi").select(*df.columns), f"{s}-free")
        for s, df, k in zip(("left", "right"), (left, right), kept)
    ]
    return *side_by_side(*sides), tuple(kept)
