"""Matching the columns of two tables by what they hold.

Each column gets a sketch of its distinct values (the smallest hashes of them), all columns of
a table in one aggregation that merges sketches map-side. The sketches of two columns tell how
much of the left one the right one contains. Pairs that the estimate does not clearly exclude are
counted exactly, by one join on the distinct values of just these columns.

The score is the share of the left column's distinct values that the right column has. Values are
compared as identifiers are: text trimmed and in lower case, whole numbers alike in any type.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.functions.text import id_text, is_scalar
from tabweld.operators.schema_match import SCORE_DIGITS
from tabweld.session import materialize

#: Share of a left column's values that its match must hold.
CONTENT_THRESHOLD = 0.5
#: A sketch keeps about two to this power hashes.
SKETCH_BITS = 12
#: A pair is left out if its estimate is so many standard errors too low.
ERRORS = 6.0


def _forms(df: DataFrame, skip: set[str]) -> list[tuple[int, str, object]]:
    """Position, name and comparable text (null if empty) of each column that can be compared."""
    forms = []
    for i, f in enumerate(df.schema):
        if is_scalar(f.dataType) and f.name not in skip:
            forms.append((i, f.name, F.nullif(id_text(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType), F.lit(""))))
    return forms


def column_sketches(df: DataFrame, skip: set[str] = frozenset()) -> DataFrame:
    """``position``, ``column_name``, ``distinct`` (estimated) and ``sketch`` of the columns, from one scan."""
    forms = _forms(df, skip)
    if not forms:
        return df.sparkSession.createDataFrame([], "position int, column_name string, distinct double, sketch binary")
    made = df.agg(*[F.theta_sketch_agg(form, F.lit(SKETCH_BITS)).alias(f"s{i}") for i, _, form in forms])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, n, _ in forms])
    return made.select(F.inline(rows)).select("position", "column_name", F.theta_sketch_estimate("sketch").cast("double").alias("distinct"), "sketch")


def estimated_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of columns with ``share``, the estimated containment of the left one, and ``most``, what it may be.

    ``left`` and ``right`` are sketches. Sketches compare the left values whose hashes both have kept:
    the fewer these are, the wider the error. The number of pairs is that of columns.
    """
    a = left.select(F.lit(0).alias("pair"), F.col("position").alias("left_position"), F.col("distinct").alias("left_distinct"), F.col("sketch").alias("a"))
    b = right.select(F.lit(0).alias("pair"), F.col("position").alias("right_position"), F.col("distinct").alias("right_distinct"), F.col("sketch").alias("b"))
    pairs = a.join(b, "pair").where((F.col("left_distinct") > 0) & (F.col("right_distinct") > 0))
    shared = F.theta_sketch_estimate(F.theta_intersection("a", "b"))
    kept = F.least(F.lit(1.0), F.lit(float(1 << SKETCH_BITS)) / F.greatest("left_distinct", "right_distinct"))
    seen = F.greatest(F.lit(1.0), F.col("left_distinct") * kept)
    error = F.when(kept < 1, F.lit(ERRORS * 0.5) / F.sqrt(seen) + F.lit(ERRORS / math.sqrt(1 << SKETCH_BITS))).otherwise(0.0)
    share = shared / F.col("left_distinct")
    return pairs.select("left_position", "right_position", share.alias("share"), (share + error).alias("most"))


def _distinct_values(df: DataFrame, positions: set[int], name: str) -> DataFrame:
    """``position`` and ``value``: the distinct values of the given columns, null and empty ones left out."""
    cells = [F.struct(F.lit(i).alias("position"), form.alias("value")) for i, _, form in _forms(df, set()) if i in positions]
    return materialize(df.select(F.inline(F.array(*cells))).where("value is not null").distinct(), name)


def content_scores(left: DataFrame, right: DataFrame, threshold: float = CONTENT_THRESHOLD, skip_left: set[str] = frozenset(), skip_right: set[str] = frozenset()) -> DataFrame:
    """``left_position, left_column, right_position, right_column, score, overlap`` of all pairs of at least ``threshold``.

    ``score`` is exact: the left column's distinct values that the right column has, by all of them;
    ``overlap`` is the same by the values of both columns together.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    schema = "left_position int, left_column string, right_position int, right_column string, score double, overlap double"
    sketches = [materialize(column_sketches(df, skip), "column-sketches") for df, skip in ((left, skip_left), (right, skip_right))]
    near = estimated_containment(*sketches).where(F.col("most") >= threshold - 1e-9).select("left_position", "right_position").collect()
    if not near:
        return left.sparkSession.createDataFrame([], schema)
    lefts, rights = ({r[k] for r in near} for k in (0, 1))
    a, b = _distinct_values(left, lefts, "left-values"), _distinct_values(right, rights, "right-values")
    sizes = [v.groupBy("position").agg(F.count("*").alias("n")) for v in (a, b)]
    width = len(right.columns)
    wanted = [r.left_position * width + r.right_position for r in near]
    meet = a.withColumnRenamed("position", "left_position").join(b.withColumnRenamed("position", "right_position"), "value")
    meet = meet.where((F.col("left_position") * width + F.col("right_position")).isin(wanted))
    shared = meet.groupBy("left_position", "right_position").agg(F.count("*").alias("shared"))
    names = [F.array(*map(F.lit, df.columns)) for df in (left, right)]
    counted = shared.join(sizes[0].select(F.col("position").alias("left_position"), F.col("n").alias("p")), "left_position")
    counted = counted.join(sizes[1].select(F.col("position").alias("right_position"), F.col("n").alias("q")), "right_position")
    score = F.round(F.col("shared") / F.col("p"), SCORE_DIGITS)
    overlap = F.round(F.col("shared") / (F.col("p") + F.col("q") - F.col("shared")), SCORE_DIGITS)
    found = counted.select(
        "left_position", F.get(names[0], F.col("left_position")).alias("left_column"),
        "right_position", F.get(names[1], F.col("right_position")).alias("right_column"),
        score.alias("score"), overlap.alias("overlap"),
    )
    return found.where(F.col("score") >= threshold)


def content_matches(left: DataFrame, right: DataFrame, threshold: float = CONTENT_THRESHOLD, skip_left: set[str] = frozenset(), skip_right: set[str] = frozenset()) -> DataFrame:
    """``left_position, left_column, right_column, score``: column matches by content.

    Each left column's best right column: highest score, then overlap, then first position. A right
    column that several chose goes to the best of them in the same order; the others get none.
    """
    scores = content_scores(left, right, threshold, skip_left, skip_right)
    order = F.max(F.struct("score", "overlap", (-F.col("right_position")).alias("order"), "right_position", "right_column")).alias("best")
    chosen = scores.groupBy("left_position", "left_column").agg(order)
    taken = F.max(F.struct("best.score", "best.overlap", (-F.col("left_position")).alias("order"), "left_position", "left_column")).alias("first")
    return (
        chosen.groupBy(F.col("best.right_position").alias("right_position"), F.col("best.right_column").alias("right_column"))
        .agg(taken)
        .select("first.left_position", "first.left_column", "right_column", "first.score")
    )


def match_by_content(left: DataFrame, right: DataFrame, known: dict[str, str], threshold: float = CONTENT_THRESHOLD) -> dict[str, str]:
    """``known`` column matches and, for the columns that take no part in them, those by content; in left column order."""
    rows = content_matches(left, right, threshold, set(known), set(known.values())).collect()
    found = known | {r.left_column: r.right_column for r in rows}
    return {c: found[c] for c in left.columns if c in found}
