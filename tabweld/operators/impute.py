"""Imputation: exact medians for numbers, exact lowest modes for everything else.

Spark's own exact ``percentile`` and ``mode`` hold every distinct value of a column in one
task. Here, at any size, modes are counted with a shuffle by value; medians are bracketed
with a bounded quantile sketch and read off the range-partitioned value counts inside the
bracket.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions.text import is_decimal, is_numeric, is_scalar, is_text
from tabweld.session import materialize

SKETCH_ACCURACY = 10_000


def null_counts(df: DataFrame, columns: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows of the table and nulls per column, in one pass."""
    columns = df.columns if columns is None else columns
    row = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in columns]).first()
    return row[0], dict(zip(columns, row[1:]))


def assert_no_nulls(df: DataFrame, ignore: tuple[str, ...] = ("match_score",)) -> None:
    """Raise, naming the columns, if any but the ignored ones holds a null."""
    _, nulls = null_counts(df, [c for c in df.columns if c not in ignore])
    bad = {c: n for c, n in nulls.items() if n}
    if bad:
        raise ValueError(f"nulls remain: {bad}")


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``place, value, n`` of every distinct value of columns of one type, in one pass.

    ``place`` is the column's place in the list.
    """
    values = [F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    melted = df.select(F.inline(F.array(*values))).filter(F.col("value").isNotNull())
    return melted.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))


def _bracketed_counts(df: DataFrame, ends: dict[str, tuple[float, float]]) -> DataFrame:
    """``place, under, value, n``: values inside each column's bracket, and one count below it."""
    values = []
    for i, (c, (low, high)) in enumerate(ends.items()):
        column, place = F.col(c), F.when(F.col(c) <= high, F.lit(i))
        values.append(F.struct(place.alias("place"), (column < low).alias("under"), F.when(column >= low, column).alias("value")))
    melted = df.select(F.inline(F.array(*values))).filter(F.col("place").isNotNull())
    return melted.groupBy("place", "under", "value").agg(F.count(F.lit(1)).alias("n"))


def medians(df: DataFrame, present: dict[str, int]) -> dict[str, float | Decimal | None]:
    """Exact median per column, null if it has no value; ``present`` counts its values.

    Decimals stay decimals, with a digit more for the mean of two middles; other numbers are doubles.
    """
    found: dict[str, float | Decimal | None] = {c: None for c, n in present.items() if not n}
    by_type: dict[str, list[str]] = {}
    for c, n in present.items():
        if n:
            dtype = df.schema[c].dataType
            by_type.setdefault(dtype.simpleString() if is_decimal(dtype) else "double", []).append(c)
    for dtype, columns in by_type.items():
        found |= _medians(df.select(*[F.col(c).cast(dtype).alias(c) for c in columns]), {c: present[c] for c in columns})
    return found


def _medians(df: DataFrame, present: dict[str, int]) -> dict[str, float | Decimal]:
    """Medians of columns of one type that have values."""
    columns = list(present)
    margin = 4.0 / SKETCH_ACCURACY
    marks = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    sketched = df.agg(*[F.percentile_approx(c, marks, SKETCH_ACCURACY) for c in columns]).first()
    found = _middle_values(df, present, {c: tuple(e) for c, e in zip(columns, sketched)})
    # The sketch's error is bounded, so a bracket holds the middle; if one did not, all values do.
    missed = {c: present[c] for c in columns if c not in found}
    if missed:
        found |= _middle_values(df, missed, dict.fromkeys(missed, (float("-inf"), float("inf"))))
    return found


def _middle_values(df: DataFrame, present: dict[str, int], ends: dict[str, tuple[float, float]]) -> dict[str, float]:
    columns = list(present)
    want = {c: ((n - 1) // 2, n // 2) for c, n in present.items()}
    # Distinct values spread evenly over range partitions; only those that hold the
    # middle ranks are read again.
    counted = _bracketed_counts(df, ends).repartitionByRange("place", "value")
    counted = materialize(counted.withColumn("part", F.spark_partition_id()), "values")
    seen = counted.groupBy("place").agg(F.sum(F.when(F.col("under"), F.col("n")).otherwise(0)).alias("under"), F.sum("n").alias("upto")).collect()
    below = {columns[r["place"]]: r["under"] for r in seen if r["under"] <= want[columns[r["place"]]][0] and want[columns[r["place"]]][1] < r["upto"]}
    if not below:
        return {}
    counted = counted.filter(~F.col("under") & F.col("place").isin([columns.index(c) for c in below]))
    sizes = counted.groupBy("place", "part").agg(F.sum("n").alias("size"))
    first, last, base = (
        F.element_at(F.array(*[F.lit(v) for v in values]), F.col("place") + 1)
        for values in ([w[0] for w in want.values()], [w[1] for w in want.values()], [below.get(c, 0) for c in columns])
    )
    end = F.sum("size").over(W.partitionBy("place").orderBy("part")) + base
    sizes = sizes.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    hit = [(F.col("start") <= k) & (F.col("end") > k) for k in (first, last)]
    # At most two parts per column.
    parts = F.broadcast(sizes.filter(hit[0] | hit[1]).select("place", "part", "start"))
    upto = F.sum("n").over(W.partitionBy("place", "part").orderBy("value")) + F.col("start")
    ranked = counted.join(parts, ["place", "part"]).withColumn("upto", upto)
    middle = [F.min(F.when(F.col("upto") > k, F.col("value"))) for k in (first, last)]
    rows = ranked.groupBy("place").agg(*middle).collect()
    return {columns[place]: low if low == high else _halfway(low, high) for place, low, high in rows}


def _halfway(low: float | Decimal, high: float | Decimal) -> float | Decimal:
    if isinstance(low, Decimal):
        with localcontext(prec=50):
            return (low + high) / 2
    return low * 0.5 + high * 0.5  # halves first: no overflow


def modes(df: DataFrame, present: dict[str, int]) -> dict[str, object]:
    """Most frequent value per column, the lowest of equals, null if it has no value."""
    found: dict[str, object] = {c: None for c in present}
    by_type: dict[str, list[str]] = {}
    for c, n in present.items():
        if n:
            by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for columns in by_type.values():
        top = F.min(F.struct(-F.col("n"), F.col("value").alias("value"))).alias("top")
        for row in _value_counts(df, columns).groupBy("place").agg(top).collect():
            found[columns[row["place"]]] = row["top"]["value"]
    return found


def fill_values(
    df: DataFrame, rows: int, nulls: dict[str, int], number_default: float | None = None, text_default: str = ""
) -> dict[str, object]:
    """What to put in place of the nulls of each column that has some."""
    types = {f.name: f.dataType for f in df.schema}
    gaps = {c: rows - n for c, n in nulls.items() if n and is_scalar(types[c])}
    numbers = {c: n for c, n in gaps.items() if is_numeric(types[c])}
    others = {c: n for c, n in gaps.items() if c not in numbers}
    fills: dict[str, object] = {}
    fills |= medians(df, numbers) if numbers else {}
    fills |= modes(df, others) if others else {}
    for c in numbers:
        fills[c] = number_default if fills[c] is None else fills[c]
    for c in others:
        if fills[c] is None and is_text(types[c]):
            fills[c] = text_default
    return fills


def fill(column: Column, dtype: T.DataType, value: object) -> Column:
    """The column with its nulls replaced; whole numbers widen to double, as a median may, and
    decimals by a digit. Decimals of 38 digits have none left: their fill is rounded."""
    if value is None:
        return column
    if is_decimal(dtype):
        wide = dtype if dtype.precision == 38 else T.DecimalType(dtype.precision + 1, dtype.scale + 1)
        exact = F.lit(str(value)).cast("decimal(38, %d)" % min(38, dtype.scale + 1))
        return F.coalesce(column.cast(wide), exact.cast(wide))
    if is_numeric(dtype):
        return F.coalesce(column.cast("double"), F.lit(float(value)))
    return F.coalesce(column, F.lit(value).cast(dtype))


def apply_fills(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return df.select(
        *[fill(F.col(f.name), f.dataType, fills.get(f.name)).alias(f.name) for f in df.schema]
    )


def impute_missing_values(
    df: DataFrame,
    columns: list[str] | None = None,
    number_default: float | None = None,
    text_default: str = "",
) -> DataFrame:
    """Fill nulls with the median (numbers) or mode (the rest) of their column."""
    rows, nulls = null_counts(df, columns)
    return apply_fills(df, fill_values(df, rows, nulls, number_default, text_default))
