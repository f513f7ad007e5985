import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld import merge_datasets, preprocess_datasets
from tabweld.operators.evaluate import evaluate_pairs
from tabweld.plans.merge import align, common_type
from tests import brute

LEFT = "user_id int, name string, age int"
RIGHT = "userid int, full_name string, age_years double"


@pytest.fixture(scope="module")
def samples(spark):
    left = spark.createDataFrame([(1, "John Doe", 25), (2, "Jane Smith", 30), (3, None, None)], LEFT)
    right = spark.createDataFrame([(4, "Bob Wilson", 35.0), (5, "Alice Brown", None), (6, "Charlie Davis", 45.0)], RIGHT)
    return left, right


def test_complete_merge(samples):
    left, right = samples
    merged, stats = merge_datasets(left, right, verify=True)
    rows = merged.collect()
    assert len(rows) == 6
    assert merged.columns == ["user_id", "name", "age", "userid", "full_name", "age_years", "is_matched", "match_score"]
    assert merged.schema["is_matched"].dataType == T.BooleanType()
    assert all(r[c] is not None for r in rows for c in merged.columns if c != "match_score")
    assert stats["schema_matches"] == {"user_id": "userid", "name": "full_name", "age": "age_years"}
    assert stats["total_matches"] == 0 and stats["unmatched_df1"] == stats["unmatched_df2"] == 3
    # Left rows take the right-named columns' median and mode, not their own values.
    first = next(r for r in rows if r["user_id"] == 1)
    assert (first["userid"], first["full_name"], first["age_years"]) == (5.0, "Alice Brown", 40.0)


def test_preprocessing(samples):
    a, b, matches = preprocess_datasets(*samples)
    assert sorted(map(tuple, a.collect())) == [(1, "john doe", 25.0), (2, "jane smith", 30.0), (3, "jane smith", 27.5)]
    assert len(matches) == 3 and b.columns == ["userid", "full_name", "age_years"]


@pytest.mark.parametrize("size, ratio", [(100, 0.7)])
def test_accuracy_against_ground_truth(spark, size, ratio):
    rng = random.Random(size)
    m = int(size * ratio)
    left = [(i, f"Person{i}" if i < m else f"Unique1_{i - m}", rng.randint(20, 79)) for i in range(size)]
    right = [(i, f"PERSON{i}", left[i][2] + rng.randint(-2, 2)) for i in range(m)]
    right += [(size + i, f"Unique2_{i}", rng.randint(20, 79)) for i in range(size - m)]
    schemas = (LEFT, RIGHT.replace("double", "int"))
    merged, stats = merge_datasets(*(spark.createDataFrame(r, s) for r, s in zip((left, right), schemas)), left_key="user_id", right_key="userid")
    truth = spark.createDataFrame([(i, i) for i in range(m)], "left_id long, right_id long")
    scores = evaluate_pairs(stats["matched_pairs"], truth).first()
    assert scores["precision"] >= 0.8 and scores["recall"] >= 0.8 and scores["f1"] >= 0.8
    names = [[c.split()[0] for c in s.split(", ")] for s in schemas]
    rows = [[dict(zip(n, r)) for r in side] for n, side in zip(names, (left, right))]
    want = brute.match(*rows, stats["schema_matches"], 0.85, "user_id", "userid")
    assert sorted(map(tuple, stats["matched_pairs"].collect())) == want
    assert merged.filter("is_matched").count() == 2 * stats["total_matches"]


def test_customers_of_two_shops(spark):
    left = [(1000 + i, f"c{i}@mail.com", "Paris" if i % 2 else "Rome", 10.0 * i) for i in range(1, 8)]
    right = [(i, e, c.upper(), p + 1, "gold") for i, e, c, p in left if i in (1001, 1003, 1005)] + [(2000, "z@mail.com", "Oslo", 3.0, "tin")]
    a = spark.createDataFrame(left, "customer_id int, email string, city string, total_purchases double")
    b = spark.createDataFrame(right, "cust_id int, email string, city string, purchases double, tier string")
    merged, stats = merge_datasets(a, b)
    assert stats["schema_matches"] == {"customer_id": "cust_id", "email": "email", "city": "city", "total_purchases": "purchases"}
    assert {r["customer_id"] for r in merged.filter("is_matched").collect()} == {1001, 1003, 1005}
    assert merged.count() == 11 and set(a.columns) | set(b.columns) <= set(merged.columns)


def test_copies_stay_in_the_union_unmatched(spark):
    left = spark.createDataFrame([(1, "ann", 5)] * 3 + [(2, "bob", 6)], LEFT)
    right = spark.createDataFrame([(1, "ann", 5.0), (2, "bob", 6.0)], RIGHT)
    merged, stats = merge_datasets(left, right)
    assert merged.count() == 6 and stats["total_matches"] == 2
    assert merged.filter("is_matched").count() == 4


def test_keyless_merge_from_one_and_from_many_files(spark):
    """Ties between equal scores are broken by positions, which do not follow the files."""
    left = spark.createDataFrame([(i % 40, f"name{i % 7}", i % 3) for i in range(400)], LEFT)
    right = spark.createDataFrame([(i % 40, f"NAME{i % 5}", float(i % 4)) for i in range(300)], RIGHT)
    seen = []
    for files in (1, 40):
        merged, stats = merge_datasets(left.repartition(files), right.repartition(files), 0.8)
        assert stats["total_matches"] > 0
        seen.append((sorted(map(repr, merged.collect())), sorted(map(tuple, stats["matched_pairs"].collect()))))
    assert seen[0] == seen[1]


def test_empty_and_unrelated_tables(samples, spark):
    left, right = samples
    merged, stats = merge_datasets(left, right.limit(0))
    assert merged.count() == 3 and stats["total_matches"] == 0
    merged, stats = merge_datasets(left, spark.createDataFrame([("q",)], "zzz string"))
    assert merged.count() == 4 and stats["schema_matches"] == {} and stats["total_matches"] == 0


def test_options(samples, spark):
    left, right = samples
    aligned, _ = merge_datasets(left, right, align_both=True, schema_matches={"user_id": "userid", "name": "full_name"})
    assert {(r["user_id"], r["userid"]) for r in aligned.collect()} == {(i, i) for i in range(1, 7)}
    with pytest.raises(ValueError, match="reserved"):
        merge_datasets(left.withColumn("is_matched", F.lit(True)), right)


def test_imputed_and_unimputed_identifiers(spark):
    left = spark.createDataFrame([(1, "ann", 5.0), (None, "bob", 6.0), (3, "cyd", 9.0)], "user_id int, name string, age double")
    right = spark.createDataFrame([(2, "bob", 6.0), (1, "ann", 5.0)], "userid int, full_name string, age_years double")
    names = {"user_id": "userid", "name": "full_name", "age": "age_years"}
    # The missing identifier becomes the median, 2, and matches.
    assert merge_datasets(left, right, schema_matches=names)[1]["total_matches"] == 2
    pairs = merge_datasets(left, right, schema_matches=names, impute_ids=False)[1]["matched_pairs"]
    scores = sorted(r["score"] for r in pairs.collect())
    assert len(scores) == 2 and scores[0] < 1.0 and scores[1] == 1.0


def test_type_conflicts_become_text(spark):
    left, right = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([("x", 2.5)], "a string, b double")
    out = align(left, right, {})
    assert [f.dataType for f in out.schema] == [T.StringType(), T.DoubleType()]
    assert sorted(map(tuple, out.collect())) == [("1", 2.0), ("x", 2.5)]
    assert common_type(T.IntegerType(), T.LongType()) == T.LongType()


def test_mapped_columns_are_read_from_the_input(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(10, 20)], "b int, c int")
    out = align(left, right, {"a": "b", "b": "c"})
    assert sorted(map(tuple, out.select("a", "b", "c").collect()), key=str) == [(1, 2, None), (10, 20, 20)]


def test_values_spark_cannot_compare_are_carried_along(spark):
    left = spark.createDataFrame([(1, "ann", [1, 2])], "user_id int, name string, tags array<int>")
    right = spark.createDataFrame([(1, "ann", {"k": "v"})], "userid int, full_name string, more map<string,string>")
    merged, stats = merge_datasets(left, right, schema_matches={"user_id": "userid", "name": "full_name"})
    assert stats["total_matches"] == 1
    assert {str(r["tags"]) for r in merged.collect()} == {"[1, 2]", "None"}


@pytest.mark.parametrize(
    ("schema", "keys", "says"),
    [("user_id int, name string", [1, 1, 2], "not unique"), ("user_id int, name string", [1, None, 2], "not unique"), ("user_id double, name string", [1.2, 1.7, 2.0], "whole numbers")],
)
def test_bad_keys_are_an_error(spark, schema, keys, says):
    left = spark.createDataFrame([(k, f"n{i}") for i, k in enumerate(keys)], schema)
    right = spark.createDataFrame([(1, "n1"), (2, "n2")], "userid int, full_name string")
    with pytest.raises(ValueError, match=says):
        merge_datasets(left, right, left_key="user_id", right_key="userid")


def test_text_keys_give_positions(spark):
    left = spark.createDataFrame([("A2", 1, "ann"), ("A1", 2, "bob")], "code string, user_id int, name string")
    right = spark.createDataFrame([(1, "ann"), (2, "bob")], "userid int, full_name string")
    merged, stats = merge_datasets(left, right, left_key="code", right_key="userid", schema_matches={"user_id": "userid", "name": "full_name"})
    assert sorted((r.left_id, r.right_id) for r in stats["matched_pairs"].collect()) == [(0, 2), (1, 1)]
    assert merged.count() == 4
