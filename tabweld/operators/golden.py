"""One record per entity: matched rows fused, unmatched rows kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def golden_records(
    left: DataFrame, right: DataFrame, pairs: DataFrame, matches: dict[str, str], left_id: str, right_id: str
) -> DataFrame:
    """Left values first, the matched right row's where the left has none.

    Columns are the left ones and the unmatched right ones. Rows without a partner are
    added by anti-joins on the unique row positions: an outer join would send all of
    them to the one task of the null key. Mapped columns must be of types that go together.
    """
    a = left.withColumn("left_id", F.col(left_id).cast("bigint")).alias("a")
    b = right.withColumn("right_id", F.col(right_id).cast("bigint")).alias("b")
    links = pairs.select("left_id", "right_id")
    extra = [c for c in right.columns if c not in set(matches.values()) and c not in left.columns]

    def record(df: DataFrame, has_left: bool, has_right: bool) -> DataFrame:
        columns = []
        for c in left.columns:
            values = [F.col(f"a.{c}")] if has_left else []
            if has_right and c in matches:
                values.append(F.col(f"b.{matches[c]}"))
            columns.append((F.coalesce(*values) if values else F.lit(None)).alias(c))
        columns += [(F.col(f"b.{c}") if has_right else F.lit(None)).alias(c) for c in extra]
        return df.select(*columns)

    both = record(a.join(links, "left_id").join(b, "right_id"), True, True)
    only_left = record(a.join(links, "left_id", "left_anti"), True, False)
    only_right = record(b.join(links, "right_id", "left_anti"), False, True)
    return both.unionByName(only_left).unionByName(only_right)
