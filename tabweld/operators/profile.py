"""Column profiles, shapes and match reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, values, nulls and share of nulls, from one aggregate."""
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]
    totals = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("column_name"), F.lit(dtype).alias("data_type"), F.col(f"n{i}").alias("non_null"))
            for i, (name, dtype) in enumerate(df.dtypes)
        ]
    )
    nulls = F.col("total") - F.col("non_null")
    percent = F.when(F.col("total") > 0, F.round(nulls * 100.0 / F.col("total"), 2))
    return (
        totals.select("total", F.inline(rows))
        .select("column_name", "data_type", "non_null", nulls.alias("nulls"), percent.alias("null_percent"))
    )


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """One row: name, rows, columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_shape(df, name) for name, df in tables.items()])


def match_table(pairs: DataFrame) -> DataFrame:
    """Matched pairs with the score to two decimals."""
    return pairs.select("left_id", "right_id", F.round("score", 2).alias("match_score"))


def match_rate(matches: Column, left_rows: Column, right_rows: Column) -> Column:
    """Matches as a share of the smaller table, in percent; null if that is empty."""
    smaller = F.least(left_rows, right_rows)
    return F.when(smaller > 0, matches * 100.0 / smaller)


def merge_statistics(pairs: DataFrame, left: DataFrame, right: DataFrame, schema_matches: int) -> DataFrame:
    """One row of counts. The inputs are aggregated side by side in one union."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
            for name, df in (("matches", pairs), ("left", left), ("right", right))
        ],
    )
    row = counts.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("matches", "left", "right")])
    rate = match_rate(F.col("matches"), F.col("left"), F.col("right"))
    return row.select(
        F.col("matches").alias("total_matches"),
        F.lit(schema_matches).alias("schema_matches"),
        (F.col("left") - F.col("matches")).alias("unmatched_left"),
        (F.col("right") - F.col("matches")).alias("unmatched_right"),
        F.round(rate, 2).alias("match_rate"),
    )
