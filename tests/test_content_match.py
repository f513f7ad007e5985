"""Columns matched by content, against plain sets; matching without a merged table."""

import random

import pytest
from pyspark.sql import functions as F

from tabweld import content_matches, match_datasets, merge_datasets
from tabweld.operators import content_match


def form(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else str(value).lower()
    return str(value).strip().lower() or None


def by_hand(left, right, threshold):
    a = {c: {form(v) for v in vs} - {None} for c, vs in left.items()}
    b = {c: {form(v) for v in vs} - {None} for c, vs in right.items()}
    chosen = {}
    for i, (c, x) in enumerate(a.items()):
        best = max(((round(len(x & y) / len(x), 9), round(len(x & y) / len(x | y), 9), -j, d) for j, (d, y) in enumerate(b.items()) if x and y), default=None)
        if best and best[0] >= threshold:
            chosen.setdefault(best[3], []).append((best[0], best[1], -i, c))
    return {max(found)[3]: (d, max(found)[0]) for d, found in chosen.items()}


def frame(spark, columns, kinds):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_content_equals_sets(spark, threshold):
    random.seed(7)
    names = [f"Person {i}" for i in range(300)]
    left = {"c0": list(range(300)), "c1": names, "c2": [random.choice(["x", "Y ", None, ""]) for _ in names], "c3": [i % 7 + 0.5 for i in range(300)], "c4": [None] * 300}
    right = {"d0": [random.choice([" y", "X", "z"]) for _ in names], "d1": [n.upper() for n in names[::-1][:200]] + ["Other"] * 100, "d2": [float(i + 60) for i in range(300)], "d3": [i % 5 + 0.5 for i in range(300)], "d4": [""] * 300}
    got = content_matches(frame(spark, left, ["long", "string", "string", "double", "string"]), frame(spark, right, ["string", "string", "double", "double", "string"]), threshold)
    assert {r.left_column: (r.right_column, r.score) for r in got.collect()} == by_hand(left, right, threshold)


def test_large_columns_are_estimated_and_then_counted(spark):
    left = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"), F.concat(F.lit("t"), "id").alias("c"))
    right = spark.range(30_000).select((F.col("id") + 9_000).alias("x"), F.concat(F.lit("T"), F.col("id") + 30_000).alias("y"), (F.col("id") * 14).alias("z"))
    estimates = content_match.estimated_containment(content_match.column_sketches(left), content_match.column_sketches(right)).collect()
    exact = {(0, 0): 0.55, (0, 2): 1429 / 20_000, (1, 2): 0.5, (2, 1): 0.0}
    for r in estimates:
        true = exact.get((r.left_position, r.right_position))
        if true is not None:
            assert r.share - (r.most - r.share) <= true <= r.most
    assert sum(r.most < 0.5 for r in estimates) >= 4  # most pairs are not counted
    got = {r.left_column: (r.right_column, r.score) for r in content_matches(left, right).collect()}
    assert got == {"a": ("x", 0.55), "b": ("z", 0.5)}


def test_a_column_goes_to_its_best_partner(spark):
    left = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "q")], "u string, v string")
    right = spark.createDataFrame([("a",), ("b",), ("c",)], "w string")
    assert [tuple(r) for r in content_matches(left, right).collect()] == [(0, "u", "w", 1.0)]
    assert content_matches(left.limit(0), right).count() == 0
    assert content_matches(left, spark.createDataFrame([([1],)], "w array<int>")).count() == 0
    with pytest.raises(ValueError):
        content_matches(left, right, 0)


def test_rows_of_columns_with_useless_names(spark):
    left = spark.createDataFrame([(i, f"Anna {i}", i * 10.0) for i in range(40)], "k1 long, p string, q double")
    right = spark.createDataFrame([(f"ANNA {i}", i * 10.0, i) for i in range(10, 60)], "zz string, yy double, k2 long")
    named = merge_datasets(left, right, id_columns=["k1"], left_key="k1", right_key="k2")[1]
    assert named["schema_matches"] == {} and named["total_matches"] == 0
    stats = match_datasets(left, right, id_columns=["k1"], left_key="k1", right_key="k2", match_content=0.5)
    assert stats["schema_matches"] == {"k1": "k2", "p": "zz", "q": "yy"}
    assert {tuple(r)[:2] for r in stats["matched_pairs"].collect()} == {(i, i) for i in range(10, 40)}
    assert (stats["total_matches"], stats["unmatched_df1"], stats["unmatched_df2"]) == (30, 10, 20)


def test_matching_alone_equals_matching_for_a_merge(spark):
    left = spark.createDataFrame([(i, f"n{i}", None if i % 3 else float(i)) for i in range(30)], "user_id long, name string, cost double")
    right = spark.createDataFrame([(i, f"N{i}", float(i)) for i in range(20, 50)], "userid long, name string, cost double")
    alone = match_datasets(left, right, left_key="user_id", right_key="userid")
    _, stats = merge_datasets(left, right, left_key="user_id", right_key="userid")
    for s in (alone, stats):
        s["matched_pairs"] = sorted(map(tuple, s["matched_pairs"].collect()))
    assert alone == stats and alone["total_matches"] > 0
