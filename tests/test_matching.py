import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweld.operators import candidates, group_pass, id_groups
from tabweld.operators.assign import greedy_assignment
from tabweld.operators.candidates import KeyJoin, NoLosslessJoin, value_pairs
from tabweld.operators.evaluate import evaluate_pairs
from tabweld.operators.golden import golden_records
from tabweld.operators.scoring import RowScore, plan_fields
from tabweld.plans import queries
from tabweld.plans.merge import match_rows
from tests import brute

LEFT = "row int, user_id int, name string, amount double"
RIGHT = "pos int, userid int, full_name string, total double"
MATCHES = {"user_id": "userid", "name": "full_name", "amount": "total"}
NAMES = ["ann", "anna", "bob", "robert", "zoe", "johnathan"]


def run(spark, left, right, schemas, matches, threshold, **options):
    a, b = spark.createDataFrame(left, schemas[0]), spark.createDataFrame(right, schemas[1])
    score = RowScore(plan_fields(a.schema, b.schema, matches), threshold)
    sides = score.prepare(a, a.columns[0], "left"), score.prepare(b, b.columns[0], "right")
    found = match_rows(score, *(s.withColumn(s.columns[0], F.col(s.columns[0]).cast("bigint")) for s in sides), **options)
    return sorted((r["left_id"], r["right_id"], r["score"]) for r in found.collect())


def want(left, right, schemas, matches, threshold):
    names = [[c.split()[0] for c in s.split(", ")] for s in schemas]
    rows = [[dict(zip(n, r)) for r in side] for n, side in zip(names, (left, right))]
    return brute.match(*rows, matches, threshold, names[0][0], names[1][0])


def people(rng, n, ids):
    return [(i, rng.choice(ids), rng.choice(NAMES), round(rng.uniform(1, 100), 1)) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_repeated_ids_in_short_groups(spark, threshold):
    rng = random.Random(1)
    left, right = people(rng, 60, range(20)), people(rng, 50, range(25))
    assert run(spark, left, right, (LEFT, RIGHT), MATCHES, threshold) == want(left, right, (LEFT, RIGHT), MATCHES, threshold)


@pytest.mark.parametrize("seed, names, heads", [(1, NAMES, 8), (2, ["ann"], 8), (3, ["ann", "zoe"], 5), (4, NAMES, 64)])
def test_one_id_holding_a_third_of_all_rows(spark, monkeypatch, seed, names, heads):
    monkeypatch.setattr(id_groups, "SHORT", 4)
    monkeypatch.setattr(id_groups, "HEADS", heads)
    monkeypatch.setattr(id_groups, "PIECE_ROWS", 10)
    rng = random.Random(seed)
    monkeypatch.setattr("tests.test_matching.NAMES", names)
    ids = [7] * 6 + list(range(100, 112))
    left, right = people(rng, 70, ids), people(rng, 55, ids)
    assert run(spark, left, right, (LEFT, RIGHT), MATCHES, 0.85) == want(left, right, (LEFT, RIGHT), MATCHES, 0.85)


def test_a_group_with_one_long_side(spark, monkeypatch):
    monkeypatch.setattr(id_groups, "SHORT", 4)
    rng = random.Random(9)
    left, right = people(rng, 40, [7]), people(rng, 3, [7])
    assert run(spark, left, right, (LEFT, RIGHT), MATCHES, 0.85) == want(left, right, (LEFT, RIGHT), MATCHES, 0.85)
    assert run(spark, right, left, (LEFT, RIGHT), MATCHES, 0.85) == want(right, left, (LEFT, RIGHT), MATCHES, 0.85)


def test_copies_pair_rank_with_rank(spark, monkeypatch):
    monkeypatch.setattr(id_groups, "SHORT", 4)
    left = [(i, 1, "ann", 5.0) for i in range(30)]
    right = [(i, 1, "ann", 5.0) for i in range(20)]
    got = run(spark, left, right, (LEFT, RIGHT), MATCHES, 0.85)
    assert got == sorted((29 - k, 19 - k, 1.0) for k in range(20))


TWO_LEFT = "row int, user_id int, shop_id string, name string, amount double"
TWO_RIGHT = "pos int, userid int, shopid string, full_name string, total double"
TWO = {"user_id": "userid", "shop_id": "shopid", "name": "full_name", "amount": "total"}


@pytest.mark.parametrize("threshold, needed", [(0.8, 2), (0.72, 1)])
def test_two_identifiers(spark, threshold, needed):
    rng = random.Random(3)

    def rows(n):
        return [(i, rng.randint(0, 9), "s%d" % rng.randint(0, 3), rng.choice(NAMES), rng.uniform(1, 9)) for i in range(n)]

    left, right = rows(40), rows(35)
    a = spark.createDataFrame(left, TWO_LEFT)
    assert RowScore(plan_fields(a.schema, spark.createDataFrame(right, TWO_RIGHT).schema, TWO), threshold).equal_ids_needed() == needed
    assert run(spark, left, right, (TWO_LEFT, TWO_RIGHT), TWO, threshold) == want(left, right, (TWO_LEFT, TWO_RIGHT), TWO, threshold)


@pytest.mark.parametrize("seed, threshold", [(1, 0.8), (2, 0.97)])
def test_numbers_bound_the_pairs_without_identifiers(spark, seed, threshold):
    rng = random.Random(seed)
    schemas = ("row int, name string, size double, price int", "pos int, title string, extent double, cost int")
    matches = {"name": "title", "size": "extent", "price": "cost"}

    def rows(n):
        return [(i, rng.choice(NAMES), rng.choice([0.0, rng.uniform(-5, 5), 3.0]), rng.randint(-3, 50)) for i in range(n)]

    left, right = rows(60), rows(50)
    assert run(spark, left, right, schemas, matches, threshold) == want(left, right, schemas, matches, threshold)


def test_a_band_holding_a_third_of_all_rows(spark, monkeypatch):
    """Crowded bands become grids of cells, and bands of one side only are dropped."""
    monkeypatch.setattr(candidates, "CELL_ROWS", 3)
    monkeypatch.setattr(candidates, "PAIRS_PER_TASK", 100)
    rng = random.Random(7)
    schemas = ("row int, name string, size double", "pos int, title string, extent double")

    def rows(n, far):
        return [(i, rng.choice(NAMES), rng.choice([rng.uniform(50, 51), rng.uniform(1, 40), far])) for i in range(n)]

    left, right = rows(60, 1e6), rows(50, -1e6)
    matches = {"name": "title", "size": "extent"}
    assert run(spark, left, right, schemas, matches, 0.85) == want(left, right, schemas, matches, 0.85)


def test_pairs_of_one_key_spread_over_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(candidates, "CELL_ROWS", 20)
    monkeypatch.setattr(candidates, "PAIRS_PER_TASK", 5_000)
    key = F.when(F.col("id") >= 0, "hot").alias("key")  # a literal would be optimised away
    left, right = (spark.range(n).select(F.col("id").alias(c), key) for n, c in ((400, "left_id"), (250, "right_id")))
    join = KeyJoin(left, right)
    assert join.pairs == 100_000
    pairs = join.joined().withColumn("part", F.spark_partition_id())
    assert pairs.select("left_id", "right_id").distinct().count() == pairs.count() == 100_000
    sizes = [r["count"] for r in pairs.groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 20_000


def test_rows_left_after_a_round_are_compared_at_once(spark, monkeypatch):
    """Groups between the two limits: a round first, then all pairs of what it left."""
    monkeypatch.setattr(id_groups, "SHORT", 2)
    monkeypatch.setattr(id_groups, "HEADS", 6)
    rng = random.Random(11)
    left, right = people(rng, 60, range(4)), people(rng, 60, range(4))
    assert run(spark, left, right, (LEFT, RIGHT), MATCHES, 0.9) == want(left, right, (LEFT, RIGHT), MATCHES, 0.9)


@pytest.mark.parametrize("seed, sizes, names", [(1, [3.0, 4.0], ["ann"]), (2, [3.0, 3.1, 9.0], ["ann", "anna", "anne"]), (3, [2.0], ["bob"])])
def test_copies_without_identifiers(spark, seed, sizes, names):
    """Few distinct forms: many rows look alike on both sides, with ties between forms."""
    rng = random.Random(seed)
    schemas = ("row int, name string, size double", "pos int, title string, extent double")
    left, right = ([(i, rng.choice(names), rng.choice(sizes)) for i in range(n)] for n in (40, 30))
    matches = {"name": "title", "size": "extent"}
    assert run(spark, left, right, schemas, matches, 0.85) == want(left, right, schemas, matches, 0.85)


def test_null_identifiers_match_on_the_other_columns(spark):
    rng = random.Random(8)
    left, right = ([(*r[:1], r[1] if r[1] % 3 else None, *r[2:]) for r in people(rng, n, range(9))] for n in (30, 25))
    got = run(spark, left, right, (LEFT, RIGHT), MATCHES, 0.85, ids_may_be_null=True)
    assert got == want(left, right, (LEFT, RIGHT), MATCHES, 0.85)


def test_many_numbers_use_the_sharpest_bands(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "d"]
    schemas = ("row int, " + ", ".join(f"{n} double" for n in names), "pos int, " + ", ".join(f"{n}{n} double" for n in names))
    left, right = ([(i, *(rng.choice([1.0, 2.0, 2.1, 40.0]) for _ in names)) for i in range(n)] for n in (40, 40))
    matches = {n: n + n for n in names}
    assert run(spark, left, right, schemas, matches, 0.92) == want(left, right, schemas, matches, 0.92)


def test_no_silent_loss_where_nothing_bounds_the_pairs(spark):
    schemas = ("row int, name string", "pos int, title string")
    with pytest.raises(NoLosslessJoin):
        run(spark, [(1, "a")], [(1, "a")], schemas, {"name": "title"}, 0.7)
    rows = [(i, "a", 1.0 + i / 1000, 1) for i in range(10)]
    schemas = ("row int, name string, size double, price int", "pos int, title string, extent double, cost int")
    with pytest.raises(NoLosslessJoin, match="max_pairs"):
        run(spark, rows, rows, schemas, {"name": "title", "size": "extent", "price": "cost"}, 0.9, max_pairs=99)


WORDS = ["steel", "brass", "plated", "anodized", "small", "large", "nickel", "tin", "copper", "polished"]


def respelled(rng, text):
    at = rng.randrange(len(text))
    return text[:at] + rng.choice(["", "x", text[at].upper()]) + text[at + 1 :]


@pytest.mark.parametrize("threshold", [0.85, 0.75])
def test_texts_alone_match_by_their_bigrams(spark, threshold):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.sample(WORDS, 3)), rng.choice(WORDS)) for i in range(60)]
    other = [(100 + i, respelled(rng, n), respelled(rng, k)) for i, n, k in rng.sample(rows, 45)]
    schemas = ("row int, name string, kind string", "pos int, title string, sort string")
    matches = {"name": "title", "kind": "sort"}
    assert run(spark, rows, other, schemas, matches, threshold) == want(rows, other, schemas, matches, threshold)


@pytest.mark.parametrize(("ids", "count"), [(0, 6), (1, 12)])
def test_many_numbers_match_by_their_bigrams(spark, ids, count):
    rng = random.Random(12)
    names = [f"n{i}" for i in range(count)]
    head = ("row int, user_id int, ", "pos int, userid int, ") if ids else ("row int, ", "pos int, ")
    schemas = (head[0] + ", ".join(f"{n} double" for n in names), head[1] + ", ".join(f"{n}x double" for n in names))
    key = lambda i: ((i,) if ids else ())
    rows = [(i, *key(i), *(round(rng.uniform(1, 99), 2) for _ in names)) for i in range(40)]
    other = [(100 + r[0], *key(r[0] + (r[0] % 3 == 0)), *(v if rng.random() < 0.8 else round(v * 1.1, 2) for v in r[1 + ids :])) for r in rows]
    matches = ({"user_id": "userid"} if ids else {}) | {n: n + "x" for n in names}
    assert run(spark, rows, other, schemas, matches, 0.85) == want(rows, other, schemas, matches, 0.85)


def test_customers_by_numbers_takes_all_customers(spark):
    sf = "/root/testdata/sf0.001"
    rows = [[r.asDict() for r in queries.sql(spark, sf, q, "customer").collect()] for q in (queries.NUMBERS_A, queries.NUMBERS_B)]
    everyone = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert [len(side) for side in rows] == [everyone, everyone]
    got = sorted((r.left_id, r.right_id, r.match_score) for r in queries.customers_by_numbers(spark, sf).collect())
    rows = [[{c: float(x) if isinstance(x, Decimal) else x for c, x in r.items()} for r in side] for side in rows]
    found = brute.match(*rows, {c: c * 2 for c in "abcdef"}, 0.85, "row_no", "pos")
    assert got == [(a, b, pytest.approx(s, abs=1e-6)) for a, b, s in sorted(found)]


@pytest.mark.parametrize("seed", range(2))
def test_greedy_rounds_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randint(0, 9), rng.randint(0, 9)): rng.choice([0.9, 0.95, 1.0]) for _ in range(60)}.items())
    edges = [(a, b, s) for (a, b), s in edges]
    got = greedy_assignment(spark.createDataFrame(edges, "left_id long, right_id long, score double"))
    assert sorted(map(tuple, got.collect())) == brute.greedy([(s, a, b) for a, b, s in edges])


def test_texts_are_measured_once_per_stage(spark):
    """A filter on a measure must not run the measure twice."""
    a, b = spark.createDataFrame([(1, 1, "x", 1.0)], LEFT), spark.createDataFrame([(1, 1, "x", 1.0)], RIGHT)
    score = RowScore(plan_fields(a.schema, b.schema, MATCHES), 0.85)
    pairs = score.prepare(a, "row", "left").join(score.prepare(b, "pos", "right"), F.col("l0") == F.col("r0"))
    plan = score.passing(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_only_the_top_partners_of_a_head_are_shuffled(spark):
    """The rank limit must apply before the shuffle, or a head's partners meet in one task."""
    a, b = spark.createDataFrame([(1, 1, "x", 1.0)], LEFT), spark.createDataFrame([(1, 1, "x", 1.0)], RIGHT)
    score = RowScore(plan_fields(a.schema, b.schema, MATCHES), 0.85)
    kept = id_groups.top_partners(score, score.prepare(a, "row", "left").crossJoin(score.prepare(b, "pos", "right")).withColumn("key", F.col("l0")), "left", "right")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_identifier_join_is_an_equi_join(spark):
    a, b = spark.range(10).selectExpr("id as row", "id as user_id"), spark.range(10).selectExpr("id as pos", "id as userid")
    score = RowScore(plan_fields(a.schema, b.schema, {"user_id": "userid"}), 0.85)
    pairs = value_pairs(
        RowScore(plan_fields(a.schema, b.schema, {"row": "pos"}), 0.95),
        *(RowScore(plan_fields(a.schema, b.schema, {"row": "pos"}), 0.95).prepare(d, d.columns[0], s) for d, s in ((a, "left"), (b, "right"))),
        max_pairs=1000,
    )
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert score.equal_ids_needed() == 1


def test_evaluation(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "left_id long, right_id long")

    row = evaluate_pairs(frame([(1, 1), (2, 2), (2, 2), (3, 4)]), frame([(1, 1), (2, 2), (5, 5), (6, 6)])).first()
    assert (row["predicted"], row["actual"], row["correct"]) == (3, 4, 2)
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == 0.5 and row["f1"] == pytest.approx(4 / 7)
    assert tuple(evaluate_pairs(frame([]), frame([(1, 1)])).first())[3:] == (0.0, 0.0, 0.0)


def test_golden_records(spark):
    left = spark.createDataFrame([(1, None), (2, "b")], "id int, name string")
    right = spark.createDataFrame([(10, "x", 5), (11, "y", 6)], "key int, title string, extra int")
    pairs = spark.createDataFrame([(1, 10, 1.0)], "left_id long, right_id long, score double")
    got = golden_records(left, right, pairs, {"id": "key", "name": "title"}, "id", "key")
    assert sorted(map(tuple, got.collect())) == [(1, "x", 5), (2, "b", None), (11, "y", 6)]


@pytest.mark.parametrize("seed, names, threshold", [(1, NAMES, 0.85), (2, ["ann", "", None], 0.9), (3, ["ann", "zoe"], 0.95)])
def test_groups_passed_in_one_task(spark, monkeypatch, seed, names, threshold):
    monkeypatch.setattr(id_groups, "FEW", 4)
    monkeypatch.setattr(group_pass, "STRIP", 5)
    monkeypatch.setattr("tests.test_matching.NAMES", [n for n in names if n is not None])
    rng = random.Random(seed)
    ids = [7] * 4 + [8, 9] * 2 + list(range(100, 106))
    left, right = people(rng, 90, ids), people(rng, 70, ids)
    left += [(1000 + i, 7, rng.choice(NAMES), 0.0) for i in range(3)]
    assert run(spark, left, right, (LEFT, RIGHT), MATCHES, threshold) == want(left, right, (LEFT, RIGHT), MATCHES, threshold)


def test_rows_of_a_group_meet_few_others(spark):
    """A third of the right rows pass with no one; from the first of them on all pairs were compared before."""
    a = spark.createDataFrame([(i, 1, "ann", 5.0) for i in range(600)], LEFT)
    b = spark.createDataFrame([(i, 1, "ann" if i % 3 else "zoe", 5.0) for i in range(600)], LEFT.replace("row", "pos"))
    score = RowScore(plan_fields(a.schema, b.schema, {c: c for c in MATCHES}), 0.95)
    sides = [score.prepare(df, c, s).toArrow().sort_by([(f"{s}_id", "descending")]) for df, c, s in ((a, "row", "left"), (b, "pos", "right"))]
    compare, cells = group_pass.comparer(score), []

    def counted(x, y):
        passes, most = compare(x, y)
        return lambda i, j: cells.append(len(i) * len(j)) or passes(i, j), most

    pairs = group_pass.greedy_pass(*sides, counted)
    rights = [i for i in range(599, -1, -1) if i % 3]
    assert sorted(zip(*(p.tolist() for p in pairs))) == sorted(zip(range(599, 599 - len(rights), -1), rights))
    assert sum(cells) < 0.5 * 600 * 600


def test_threshold_is_met_after_rounding():
    scores = [0.85, 0.8499999995, 0.84999999949, 0.8500000001, 0.849999998]
    assert group_pass._reaches(np.array(scores), 0.85).tolist() == [True, True, False, True, False]
