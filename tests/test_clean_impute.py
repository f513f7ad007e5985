import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.operators import impute
from tabweld.operators.clean import clean_data, nan_to_null
from tabweld.operators.columns import (
    add_text_column,
    clean_column_names,
    column_types,
    drop_column,
    drop_column_into,
    export_casts,
    list_tables,
    preview,
    validate_schema_compatibility,
)
from tabweld.operators.profile import column_profile, match_rate
from tabweld.operators.row_index import rank_descending, with_content_index, with_row_index


def test_duplicates_are_removed(spark):
    df = spark.createDataFrame([(1, "John"), (1, "John"), (2, "Jane")], "id int, name string")
    assert clean_data(df).count() == 2


def test_case_variants_survive_cleaning_and_nulls_are_equal(spark):
    rows = [(1, " A "), (1, "a"), (2, None), (2, None)]
    out = clean_data(spark.createDataFrame(rows, "id int, name string"))
    assert sorted((r["id"], r["name"]) for r in out.collect() if r["name"]) == [(1, "a"), (1, "a")]
    assert out.filter(F.col("name").isNull()).count() == 1


def test_first_copy_is_kept(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "name string, row_id long")
    assert sorted(map(tuple, clean_data(df, "row_id").collect())) == [("x", 1), ("y", 2)]


def test_median_and_lowest_mode(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b"), (2, 2.0, "a"), (None, None, None), (4, 4.0, "b"), (10, float("nan"), "a")], "i int, x double, s string"
    )
    out = impute.impute_missing_values(nan_to_null(df))
    assert out.schema["i"].dataType == T.DoubleType()
    row = out.filter(F.col("i") == 3.0).first()
    assert row["x"] == 2.0 and row["s"] == "a"
    impute.assert_no_nulls(out)


def test_columns_without_nulls_keep_their_type(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "i int, b boolean")
    out = impute.impute_missing_values(df)
    assert out.schema["i"].dataType == T.IntegerType()
    assert [r["b"] for r in out.collect()] == [True, True]


def test_empty_columns(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    assert tuple(impute.impute_missing_values(df).first()) == (None, "")
    assert tuple(impute.impute_missing_values(df, number_default=0.0).first()) == (0.0, "")
    with pytest.raises(ValueError, match="x"):
        impute.assert_no_nulls(df)


@pytest.mark.parametrize("n", [1000, 1001])
@pytest.mark.parametrize("hot", [0.0, 0.34, 0.6])
def test_large_table_ways_are_exact(spark, monkeypatch, n, hot):
    """Medians and modes by narrow brackets, with a value that holds a third of the rows."""
    monkeypatch.setattr(impute, "SKETCH_ACCURACY", 50)
    rng = random.Random(n + int(hot * 100))
    xs = [500.0 if rng.random() < hot else rng.uniform(0, 1000) for _ in range(n)]
    words = ["k%d" % rng.randint(0, 40) for _ in range(n)]
    rows = [(x, w, None if i % 3 else i, i % 2 == 0) for i, (x, w) in enumerate(zip(xs, words))]
    df = spark.createDataFrame(rows, "x double, s string, i int, b boolean").repartition(7)
    got = impute.medians(df, {"x": n, "i": (n + 2) // 3})
    assert got["x"] == pytest.approx(statistics.median(xs), abs=1e-12)
    assert got["i"] == statistics.median(range(0, n, 3))
    top = max(words.count(w) for w in words)
    assert impute.modes(df, {"s": n, "b": n}) == {
        "s": min(w for w in set(words) if words.count(w) == top), "b": n % 2 == 1,
    }


@pytest.mark.parametrize(
    ("values", "median"),
    [([1.0, float("inf"), float("inf"), float("inf")], float("inf")), ([-1.7e308, 1.7e308], 0.0), ([1.7e308, 1.7e308], 1.7e308), ([5.0], 5.0), ([3.0, 4.0], 3.5)],
)
def test_median_of_extreme_values(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert impute.medians(df, {"x": len(values)}) == {"x": median}


def test_row_index_counts_from_zero(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    indexed = with_row_index(df, "n", ["v"])
    assert indexed.filter("n != v").count() == 0
    assert sorted(r["n"] for r in with_row_index(df, "n").collect()) == list(range(1000))


def test_positions_follow_contents(spark, monkeypatch):
    """Null, empty and equal values, a map, and a row with a third of all copies, from one file or many."""
    monkeypatch.setattr("tabweld.operators.row_index.COPIES_AT_ONCE", 100)
    rows = [("hot", 1, {"k": 1}, 0.5)] * 1000 + [(f"t{i % 700}", i % 5, {"k": i % 3}, None if i % 4 else float(i)) for i in range(2000)]
    rows += [(None, None, None, None)] * 3 + [("", None, None, None), ("\x1e", None, None, None)]
    df = spark.createDataFrame(rows, "`a.b` string, n int, m map<string, int>, x double")
    seen = []
    for files in (1, 40):
        indexed, distinct = with_content_index(df.repartition(files), "pos")
        found = {r.pos: tuple(r)[:-1] for r in indexed.collect()}
        assert sorted(found) == list(range(len(rows)))
        assert sorted(map(repr, found.values())) == sorted(map(repr, rows))
        firsts = {}
        for pos, row in sorted(found.items()):
            firsts.setdefault(repr(row), pos)
        assert {repr(tuple(r)[:-1]): r.pos for r in distinct.collect()} == firsts
        seen.append(found)
    assert seen[0] == seen[1]
    indexed, distinct = with_content_index(df.limit(0), "pos")
    assert indexed.columns == [*df.columns, "pos"] and indexed.count() == distinct.count() == 0
    with pytest.raises(ValueError, match="reserved"):
        with_content_index(df.withColumnRenamed("n", "_piece"))


def test_rank_of_a_group_spread_over_chunks(spark, monkeypatch):
    monkeypatch.setattr("tabweld.operators.row_index.CHUNK", 10)
    df = spark.range(100).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7).alias("row_id"))
    got = rank_descending(df, "g", "row_id").collect()
    for g in ("hot", "cold"):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: -r["row_id"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_column_names_and_columns(spark):
    df = spark.createDataFrame([(1, True)], ["User ID", " Is-OK "])
    assert clean_column_names(df).columns == ["user_id", "is_ok"]
    with pytest.raises(ValueError, match="clash"):
        clean_column_names(spark.createDataFrame([(1, 2)], ["a b", "A-B"]))
    added = add_text_column(df, "note")
    assert added.first()["note"] is None and added.schema["note"].dataType == T.StringType()
    assert drop_column(added, "note").columns == df.columns
    with pytest.raises(ValueError):
        drop_column(df, "nope")
    assert export_casts(df).first()[1] == 1
    assert [tuple(r) for r in column_types(df).orderBy("position").collect()] == [(0, "User ID", "bigint"), (1, " Is-OK ", "boolean")]
    assert not validate_schema_compatibility(df, spark.range(1)) and validate_schema_compatibility(df, added)


def test_drop_into_a_modified_table(spark):
    spark.range(3).withColumn("x", F.lit(1)).write.mode("overwrite").saveAsTable("things")
    assert drop_column_into(spark, "things", "x") == "things_modified"
    assert spark.table("things_modified").columns == ["id"]
    assert {"things", "things_modified"} <= {r[0] for r in list_tables(spark).collect()}


def test_profile_of_table_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "i int, s string")
    got = {r["column_name"]: tuple(r)[1:] for r in column_profile(df).collect()}
    assert got == {"i": ("int", 3, 0, 0.0), "s": ("string", 1, 2, 66.67)}
    assert column_profile(df.limit(0)).first()["null_percent"] is None
    rate = spark.range(1).select(match_rate(F.lit(3), F.lit(4), F.lit(10)), match_rate(F.lit(0), F.lit(0), F.lit(1))).first()
    assert rate[0] == 75.0 and rate[1] is None
    assert [r["id"] for r in preview(spark.range(100, 0, -1), "id", 3).collect()] == [1, 2, 3]
