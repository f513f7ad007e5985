"""The join of dense vectors against comparing all pairs, alone and inside a match of texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabweld import NoLosslessJoin, match_datasets
from tabweld.functions.embed import embed_distinct, embedder
from tabweld.operators import metric_join
from tests import brute


def cosine(x, y):
    if not x or not y:
        return 0.0
    norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
    return sum(a * b for a, b in zip(x, y)) / norm if norm else 0.0


def sides(spark, left, right):
    a = spark.createDataFrame(left, "left_id long, left_vector array<float>").repartition(3)
    return a, spark.createDataFrame(right, "right_id long, right_vector array<float>").repartition(2)


@pytest.mark.parametrize("least", [0.2, 0.8, 0.99])
def test_all_near_pairs_once(spark, least):
    random.seed(11)
    centres = [[random.gauss(0, 1) for _ in range(6)] for _ in range(12)]

    def near():
        return [round(c + random.gauss(0, 0.1), 3) for c in random.choice(centres)]

    left = [(i, near()) for i in range(150)] + [(150, [0.0] * 6), (151, None), (152, near()), (153, [])]
    right = [(i, near()) for i in range(170)] + [(170, [0.0] * 6), (171, None), (172, left[0][1])]
    pairs = metric_join.near_vectors(*sides(spark, left, right), least).collect()
    want = {(i, j) for i, x in left for j, y in right if cosine(x, y) >= least}
    sure = {(i, j) for i, x in left for j, y in right if abs(cosine(x, y) - least) > 1e-5}
    assert len(pairs) == len({(p.left_id, p.right_id) for p in pairs})
    assert {(p.left_id, p.right_id) for p in pairs} & sure == want & sure
    assert all(abs(p.cosine - cosine(left[p.left_id][1], right[p.right_id][1])) < 1e-5 for p in pairs)


def test_clusters_are_not_compared_with_each_other(spark):
    random.seed(12)
    centres = [[random.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [c + random.gauss(0, 0.02) for c in centres[i % 40]]) for i in range(800)]
    join = metric_join.metric_join(*sides(spark, rows, rows), 0.98)
    assert 800 * 20 <= join.pairs < 0.2 * 800 * 800
    with pytest.raises(NoLosslessJoin, match="max_pairs"):
        metric_join.metric_join(*sides(spark, rows, rows), 0.98, max_pairs=100)
    with pytest.raises(NoLosslessJoin):
        metric_join.metric_join(*sides(spark, rows, rows), 0.0)
    empty = sides(spark, rows[:0], rows)
    assert metric_join.near_vectors(*empty, 0.5).count() == 0


def test_vectors_without_clusters_are_listed_once_for_a_block(spark, monkeypatch):
    """Regions listed such vectors nearly everywhere; blocks hold each once for a line."""
    monkeypatch.setattr(metric_join, "metric_join", None)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 100)
    random.seed(14)
    rows = [(i, [random.gauss(0, 1) for _ in range(24)]) for i in range(600)]
    other = [(i, [round(c + random.gauss(0, 0.2), 2) for c in x]) for i, x in rows[:300]] + [(900, None), (901, [0.0] * 24)]
    pairs = metric_join.near_vectors(*sides(spark, rows, other), 0.97)
    got = sorted((p.left_id, p.right_id) for p in pairs.collect())
    assert len(got) > 100 and got == sorted((i, j) for i, x in rows for j, y in other if cosine(x, y) >= 0.97)


def model():
    def encode(texts):
        return [[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    return encode


def test_text_tables_with_an_embedder_equal_brute_force(spark, monkeypatch):
    random.seed(13)
    syllables = ["ba", "do", "ki", "lu", "me", "ra", "sto", "vin"]

    def word():
        return "".join(random.choice(syllables) for _ in range(3))

    left = [{"name": f"{word()} {word()}", "city": word()} for _ in range(60)]
    right = [{"name": (x["name"] if i % 3 else x["name"][:-1]).upper(), "city": x["city"] if i % 4 else word()} for i, x in enumerate(left)]
    right += [{"name": f"{word()} {word()}", "city": word()} for _ in range(20)]
    for rows in (left, right):
        for i, r in enumerate(rows):
            r["place"] = i
    matches = {"name": "name", "city": "city"}
    encode = model()
    monkeypatch.setattr(brute, "bigram_cosine", lambda a, b: cosine(*encode([a, b])))
    want = brute.match(left, right, matches, 0.85, "place", "place")
    frames = [spark.createDataFrame([(r["place"], r["name"], r["city"]) for r in rows], "place long, name string, city string") for rows in (left, right)]
    stats = match_datasets(*frames, 0.85, left_key="place", right_key="place", schema_matches=matches, embed=embedder(model))
    got = sorted(tuple(r) for r in stats["matched_pairs"].select("left_id", "right_id", "score").collect())
    assert len(want) > 20 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want))


def test_each_distinct_text_is_embedded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting():
        def encode(texts):
            seen.add(len(texts))
            return [[len(t)] for t in texts]

        return encode

    rows = spark.createDataFrame([(i, None if i == 7 else f"text {i % 5}") for i in range(400)], "id long, t string").repartition(4)
    out = embed_distinct(rows, "t", embedder(counting))
    assert {r.id: r.vector for r in out.collect()} == {i: None if i == 7 else [6.0] for i in range(400)}
    assert seen.value <= 5 + 2  # a model is tried on a first row before its batches
