"""Quality of matched pairs against a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: counts, precision, recall and F1 of distinct ``(left_id, right_id)`` pairs.

    Both sides are counted in one shuffle on the pair; a ratio without a denominator is 0.
    """
    both = predicted.select("left_id", "right_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        truth.select("left_id", "right_id", F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    pairs = both.groupBy("left_id", "right_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))

    def count(what):
        return F.coalesce(F.sum(what), F.lit(0))

    counts = pairs.agg(
        count(F.col("p")).alias("predicted"),
        count(F.col("t")).alias("actual"),
        count(F.col("p") * F.col("t")).alias("correct"),
    )

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    scored = counts.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("correct"), F.col("actual"))
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))
