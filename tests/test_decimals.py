"""Columns of exact decimals: imputed, united, matched."""

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tabweld import impute_missing_values, merge_datasets
from tabweld.plans.merge import common_type


@pytest.mark.parametrize(
    "kind, values, want, wide",
    [
        ("decimal(6,2)", ["1.10", None, "1.15", "9.00", "0.05"], "1.125", "decimal(7,3)"),
        ("decimal(20,0)", ["99999999999999999991", None, "99999999999999999994"], "99999999999999999992.5", "decimal(21,1)"),
        ("decimal(38,2)", ["0.01", "0.04", None], "0.03", "decimal(38,2)"),
        ("decimal(5,1)", ["-2.5", None, "-2.5"], "-2.5", "decimal(6,2)"),
    ],
)
def test_exact_median(spark, kind, values, want, wide):
    df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], f"x {kind}")
    out = impute_missing_values(df)
    assert out.schema["x"].dataType.simpleString() == wide
    assert sorted(r.x for r in out.collect()) == sorted(Decimal(want if v is None else v) for v in values)


def test_types_of_united_columns():
    money, long = T.DecimalType(12, 2), T.LongType()
    assert common_type(money, T.DecimalType(8, 4)) == T.DecimalType(14, 4)
    assert common_type(money, long) == T.DecimalType(21, 2)
    assert common_type(T.DecimalType(38, 30), long) == T.DoubleType()
    assert common_type(money, T.DoubleType()) == T.DoubleType()
    assert common_type(money, T.StringType()) == T.StringType()


def test_rows_are_matched_and_fused_by_decimals(spark):
    left = spark.createDataFrame([(Decimal(i), f"n{i}", None if i == 3 else Decimal(i) / 4) for i in range(1, 8)], "user_id decimal(10,1), name string, cost decimal(10,2)")
    right = spark.createDataFrame([(i, f"N{i}", Decimal(i) / 4) for i in range(4, 10)], "userid long, name string, cost decimal(10,2)")
    merged, stats = merge_datasets(left, right, verify=True)
    assert stats["total_matches"] == 4
    assert merged.schema["cost"].dataType.simpleString() == "decimal(11,3)"
    assert sorted(r.cost for r in merged.collect())[:3] == [Decimal("0.25"), Decimal("0.5"), Decimal("1.00")]
