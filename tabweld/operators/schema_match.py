"""Matching the columns of tables by name.

Works on catalogs: DataFrames with one row per column, so that the columns of many
table pairs are matched in one job. A pair of tables is the case of one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.functions.similarity import bigram_cosine, jaro_winkler, vector_cosine

# Threshold, weights, and the words that add context to a name.
COLUMN_THRESHOLD = 0.6
EMBEDDING_WEIGHT = 0.7
STRING_WEIGHT = 0.3
ID_CONTEXT = " identifier primary key"
AGE_CONTEXT = " age in years numeric"
NAME_CONTEXT = " person name text"

# Scores are compared at this many decimals, so that the order of summation never
# decides a tie or a threshold.
SCORE_DIGITS = 9


def expand_name(name: Column) -> Column:
    """A column name in words, followed by the contexts that apply.

    Each test sees the text built so far, contexts included.
    """
    text = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    for words, context in ((("id",), ID_CONTEXT), (("age", "years"), AGE_CONTEXT), (("name",), NAME_CONTEXT)):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        text = F.when(hit, F.concat(text, F.lit(context))).otherwise(text)
    return text


def name_scores(left: DataFrame, right: DataFrame, on: list[str], embed=None) -> DataFrame:
    """Score every column of a left table with every column of the right table of its pair.

    ``left`` and ``right`` hold ``on`` (the table pair), ``position`` and
    ``column_name``. The work per pair is bounded by the two tables' numbers of columns.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        words = expand_name(F.col("column_name"))
        return df.select(
            *on,
            F.col("position").alias(f"{tag}_position"),
            F.col("column_name").alias(f"{tag}_column"),
            words.alias(f"{tag}_words"),
            *([embed(words).alias(f"{tag}_vector")] if embed else []),
        )

    pairs = side(left, "left").join(side(right, "right"), on)
    if embed:
        meaning = vector_cosine(F.col("left_vector"), F.col("right_vector"))
    else:
        meaning = bigram_cosine(F.col("left_words"), F.col("right_words"))
    spelling = jaro_winkler(F.lower("left_column"), F.lower("right_column"))
    score = F.round(EMBEDDING_WEIGHT * meaning + STRING_WEIGHT * spelling, SCORE_DIGITS)
    return pairs.select(*on, "left_position", "left_column", "right_position", "right_column", score.alias("score"))


def pick_matches(scores: DataFrame, on: list[str], threshold: float = COLUMN_THRESHOLD) -> DataFrame:
    """Each left column's best right column, if good enough and not taken earlier.

    Best means highest score, then first position. A right column goes to the first of
    the left columns that chose it; the others get no second choice.
    """
    best = F.max(F.struct("score", (-F.col("right_position")).alias("order"), "right_column")).alias("best")
    chosen = (
        scores.groupBy(*on, "left_position", "left_column")
        .agg(best)
        .filter(F.col("best.score") >= threshold)
        .select(*on, "left_position", "left_column", "best.right_column", "best.score")
    )
    first = F.min(F.struct("left_position", "left_column", "score")).alias("first")
    return (
        chosen.groupBy(*on, "right_column")
        .agg(first)
        .select(*on, "first.left_position", "first.left_column", "right_column", "first.score")
    )


def match_catalogs(left: DataFrame, right: DataFrame, on: list[str], embed=None) -> DataFrame:
    """Column matches of every table pair, one row per matched pair of columns."""
    return pick_matches(name_scores(left, right, on, embed), on)


def catalog(df: DataFrame) -> DataFrame:
    """The columns of one table as a catalog of the pair 0."""
    names = F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("position", "column_name")
    return df.sparkSession.range(0, 1, 1, 1).select(F.lit(0).alias("pair"), names)


def schema_matches(left: DataFrame, right: DataFrame, embed=None) -> DataFrame:
    """Column matches of two tables: ``left_position, left_column, right_column, score``."""
    return match_catalogs(catalog(left), catalog(right), ["pair"], embed).drop("pair")


def match_schemas(left: DataFrame, right: DataFrame, embed=None) -> dict[str, str]:
    """Column matches as a dict in left column order (its size is the number of columns)."""
    rows = schema_matches(left, right, embed).collect()
    return {r["left_column"]: r["right_column"] for r in sorted(rows, key=lambda r: r["left_position"])}


def unmatched_columns(columns: DataFrame, matches: DataFrame, side: str, on: list[str]) -> DataFrame:
    """Columns of a catalog that took part in no match; ``side`` is 'left' or 'right'."""
    taken = matches.select(*on, F.col(f"{side}_column").alias("column_name"))
    return columns.join(taken, [*on, "column_name"], "left_anti")
