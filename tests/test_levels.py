"""Matches by falling levels, with pairs compared in blocks, against the sequential pass over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweld.functions.similarity import _jaro_winkler
from tabweld.operators import blocks, candidates, cells, levels
from tabweld.operators.scoring import Field, RowScore
from tests import brute
from tests.test_matching import NAMES, run, want


@pytest.fixture
def small(monkeypatch):
    """Levels and blocks from the first row on."""
    taken = []
    monkeypatch.setattr(candidates, "_FEW_PAIRS", 0)
    monkeypatch.setattr(levels, "LEVEL_EDGES", 5)
    monkeypatch.setattr(levels, "ROW_EDGES", 0)
    monkeypatch.setattr(levels, "GRAM_SHARE", 0)
    monkeypatch.setattr(blocks, "TEXT_ROWS", 16)
    monkeypatch.setattr(blocks, "_FEW_ROWS", 8)
    level = levels._level
    monkeypatch.setattr(levels, "_level", lambda *a: taken.append(level(*a)) or taken[-1])
    return taken


@pytest.mark.parametrize("band_share", [0, 1])
@pytest.mark.parametrize("copies", [False, True])
def test_numbers_by_levels(spark, small, monkeypatch, band_share, copies):
    monkeypatch.setattr(levels, "BAND_SHARE", band_share)
    rng = random.Random(21)
    schemas = ("row int, name string, size double, price int", "pos int, title string, extent double, cost int")
    sizes = [2.0, 2.1, 3.0] if copies else [0.0, *(round(rng.uniform(-5, 50), 2) for _ in range(90))]
    left, right = ([(i, rng.choice(NAMES), rng.choice(sizes), rng.randint(0, 2 if copies else 40)) for i in range(n)] for n in (60, 50))
    matches = {"name": "title", "size": "extent", "price": "cost"}
    assert run(spark, left, right, schemas, matches, 0.8) == want(left, right, schemas, matches, 0.8)
    assert len(small) > 1 and small[0] > small[-1] == 0.8


def test_texts_by_levels(spark, small):
    rng = random.Random(22)
    left = [(i, f"http://{rng.choice(NAMES)}.example.net/{rng.choice(['en', 'fr'])}/{rng.randint(100, 999)}é") for i in range(70)]
    right = [(i, t.replace(".example.", ".exampel.")) for i, t in left[:60]]
    schemas = ("row int, link string", "pos int, address string")
    assert run(spark, left, right, schemas, {"link": "address"}, 0.85) == want(left, right, schemas, {"link": "address"}, 0.85)
    assert len(small) > 1


def test_many_pairs_take_levels(spark, monkeypatch):
    """A table whose bigrams and numbers bound little was compared pair by pair before."""
    monkeypatch.setattr(candidates, "_FEW_PAIRS", 1_000)
    from tabweld.plans import merge

    monkeypatch.setattr(merge, "value_pairs", None)
    rng = random.Random(23)
    left = [(i, f"{rng.choice(NAMES)} {i % 7}") for i in range(60)]
    schemas = ("row int, name string", "pos int, title string")
    assert run(spark, left, left, schemas, {"name": "title"}, 0.85) == want(left, left, schemas, {"name": "title"}, 0.85)


def test_wide_bands_are_not_joined(spark, small, monkeypatch):
    """a twentieth of all pairs in bands left billions of joined rows at 1 GB; blocks compare them now."""
    rng = random.Random(24)
    schemas = ("row int, name string, size double, price double", "pos int, title string, extent double, cost double")
    sides = [[(i, rng.choice(NAMES), 10.0 * 3 ** rng.randint(0, 4) + rng.random(), 10.0 * 3 ** rng.randint(0, 4)) for i in range(n)] for n in (60, 50)]
    matches = {"name": "title", "size": "extent", "price": "cost"}
    shares = []
    join = candidates._band_join

    def counted(row_score, left, right, known):
        band = join(row_score, left, right, known)
        shares.append(band.pairs / (left.count() * right.count()))
        return band

    monkeypatch.setattr(candidates, "_band_join", counted)
    monkeypatch.setattr(candidates.KeyJoin, "joined", None)
    assert run(spark, *sides, schemas, matches, 0.8) == want(*sides, schemas, matches, 0.8)
    assert levels.BAND_SHARE < max(shares) < 0.3


@pytest.mark.parametrize("texts", [True, False])
def test_leaves_lose_no_pair(spark, monkeypatch, texts):
    """Blocks give all pairs and scores that ``passing`` gives, whatever the signs and magnitudes."""
    monkeypatch.setattr(blocks, "LEAF_ROWS", 4)
    monkeypatch.setattr(blocks, "_TILE_CELLS", 40)
    rng = random.Random(25)
    sizes = [0.0, -0.0, -3.0, -2.9, 3.0, 2.8, 1e-40, 1.1e-40, 1e300, -1e300, 9e299, *(round(rng.uniform(-5, 50), 2) for _ in range(20))]
    fields = (Field("size", "size", "number"), Field("price", "price", "number")) + ((Field("name", "name", "text"),) if texts else ())
    for threshold in (0.6, 0.8, 0.9):
        score = RowScore(fields, threshold)
        a, b = (
            score.prepare(spark.createDataFrame([(i, rng.choice(sizes), rng.choice([-2, 0, 1, 5, 6]), rng.choice(NAMES)) for i in range(n)], "row bigint, size double, price int, name string"), "row", side)
            for n, side in ((50, "left"), (40, "right"))
        )
        a, b = a.localCheckpoint(), b.localCheckpoint()
        got = blocks.score_edges(score, a, b).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, score.passing(a.crossJoin(b)).select("left_id", "right_id", "score").collect()))
        assert got


def test_bounds_of_leaves_and_spelling():
    rng = random.Random(26)
    values = np.array([rng.choice([0.0, rng.uniform(-9, 9), rng.uniform(-1e-9, 1e-9)]) for _ in range(300)])
    for _ in range(100):
        a, b = (np.array(rng.sample(list(values), 5)) for _ in range(2))
        most = blocks._most_closeness(a, b)
        assert all(most[k] >= blocks._closeness(x, b[k : k + 1])[0] for k in range(5) for x in a)
    for _ in range(200):
        a, b = (["".join(rng.choice("abcé") for _ in range(rng.randint(0, 7))) for _ in range(3)] for _ in range(2))
        assert blocks._most_spelling(a, b) >= max(_jaro_winkler(x, y) for x in a for y in b) - 1e-12
    assert blocks._most_spelling(["customer#1", "customer#22"], ["supplier#1", "supplier#22"]) < 0.9
    leaves = blocks._leaves([values, values * 2], 300, 7)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(300)) and max(map(len, leaves)) <= 7


def test_level_at_the_top_of_many_edges(spark, monkeypatch):
    edges = spark.range(300_000).select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), (F.col("id") / 300_000).alias("score"))
    monkeypatch.setattr(levels, "score_edges", lambda *_: edges)
    monkeypatch.setattr(levels, "LEVEL_EDGES", 0)
    monkeypatch.setattr(levels, "ROW_EDGES", 1)
    left, right = spark.range(100 * levels.PROBE_ROWS).withColumnRenamed("id", "left_id"), spark.range(700).withColumnRenamed("id", "right_id")
    assert levels._level(RowScore((), 0.5), left, right, 1) == (300_000 - 7) / 300_000


def prepared(spark, score, rows, schema, key, side):
    return score.prepare(spark.createDataFrame(rows, schema), key, side).localCheckpoint()


def test_rows_go_only_to_cells_in_reach(spark, monkeypatch):
    """each row went to every line of the other side, so the shuffle grew with the square of the rows."""
    monkeypatch.setattr(blocks, "TEXT_ROWS", 16)
    monkeypatch.setattr(blocks, "_FEW_ROWS", 8)
    rng = random.Random(27)
    score = RowScore(tuple(Field(c, c, "number") for c in "abc"), 0.95)
    row = lambda i: (i, *(float(3 ** rng.randint(0, 7)) + rng.random() / 9 for _ in "abc"))
    left, right = (prepared(spark, score, [row(i) for i in range(n)], "row bigint, a double, b double, c double", "row", side) for n, side in ((400, "left"), (300, "right")))
    made = []
    monkeypatch.setattr(blocks, "Cells", lambda *a: made.append(cells.Cells(*a)) or made[-1])
    got = blocks.score_edges(score, left, right).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, score.passing(left.crossJoin(right)).select("left_id", "right_id", "score").collect()))
    reached = made[0].reached(right.toArrow().combine_chunks().to_batches()[0])[0]
    assert len(made[0].sizes) >= 25 and sum(made[0].sizes) == 400
    assert len(reached) < 300 * len(made[0].sizes) / 5


@pytest.mark.parametrize("kind", ["number", "text"])
def test_cells_lose_no_pair(spark, monkeypatch, kind):
    """Cells of unlike sizes, rows that are all alike, and lines of them give what ``passing`` gives."""
    monkeypatch.setattr(blocks, "TEXT_ROWS", 16)
    monkeypatch.setattr(blocks, "_FEW_ROWS", 8)
    monkeypatch.setattr(blocks, "LEAF_ROWS", 4)
    rng = random.Random(28)
    values = [0.0, -0.0, -3.0, 3.0, 1e300, 7.0, 7.5] if kind == "number" else ["", "é", "http://a.example.net/12", "http://b.example.net/13?page=2", "https://a.example.org/en/#top", "x" * 50]
    field, dtype = (Field("v", "v", kind), "double" if kind == "number" else "string")
    for threshold in (0.75, 0.9):
        score = RowScore((field, Field("w", "w", kind)), threshold)
        row = lambda i: (i, values[0] if i % 3 else rng.choice(values), rng.choice(values))
        left, right = (prepared(spark, score, [row(i) for i in range(n)], f"row bigint, v {dtype}, w {dtype}", "row", side) for n, side in ((120, "left"), (90, "right")))
        got = blocks.score_edges(score, left, right).collect()
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, score.passing(left.crossJoin(right)).select("left_id", "right_id", "score").collect()))


def test_texts_go_only_to_cells_in_reach(spark, monkeypatch):
    """without numbers each text was compared with all of the other side, whatever bigrams it holds."""
    monkeypatch.setattr(blocks, "TEXT_ROWS", 16)
    monkeypatch.setattr(blocks, "_FEW_ROWS", 8)
    rng = random.Random(29)
    hosts = ["aurora.example.net", "quokka.example.org", "zymurgy.example.com", "bivouac.example.net", "fjord-hymn.example.org"]
    score = RowScore((Field("link", "link", "text"),), 0.95)
    row = lambda i: (i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr'])}/{rng.randint(100, 999)}{rng.choice(['', '?utm_source=feed'])}")
    left, right = (prepared(spark, score, [row(i) for i in range(n)], "row bigint, link string", "row", side) for n, side in ((200, "left"), (150, "right")))
    made = []
    monkeypatch.setattr(blocks, "Cells", lambda *a: made.append(cells.Cells(*a)) or made[-1])
    got = blocks.score_edges(score, left, right).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, score.passing(left.crossJoin(right)).select("left_id", "right_id", "score").collect()))
    reached = made[0].reached(right.toArrow().combine_chunks().to_batches()[0])[0]
    assert len(made[0].sizes) >= 12 and len(reached) < 150 * len(made[0].sizes) / 2
    texts = [r.link for r in (left.selectExpr("l0 AS link").collect())]
    leaves = blocks._leaves([], len(texts), 10, cells.signs(texts))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(texts)))
    assert np.mean([len({texts[i].split("/")[2] for i in leaf}) for leaf in leaves]) < 1.5


@pytest.mark.parametrize("chars", [3, 1_000])
def test_bounds_of_texts(monkeypatch, chars):
    monkeypatch.setattr(cells, "_PIECE_CHARS", chars)
    rng = random.Random(30)
    draw = lambda: "".join(rng.choice("abcdé/") for _ in range(rng.choice([0, 1, 2, 5, 9])))
    for _ in range(100):
        a, b = ([draw() for _ in range(6)] for _ in range(2))
        i, j = (x.ravel() for x in np.indices((6, 6)))
        spelling = np.array([_jaro_winkler(a[x], b[y]) for x, y in zip(i, j)])
        assert (blocks._spelling_of_letters(blocks._letters(a), blocks._letters(b), i, j) >= spelling - 1e-12).all()
        lengths = cells.text_lengths(a)
        known = cells.most_spelling(cells.text_lengths(b), lengths.min(), lengths.max())
        assert (known[j] >= spelling - 1e-12).all()
        cosine = np.array([brute.bigram_cosine(a[x], b[y]) for x, y in zip(i, j)])
        near = cells.gram_weights(b) @ cells.gram_weights(a).max(axis=0)
        assert (near[j] >= cosine - 1e-5).all()
        grams = blocks._LeftGrams(a)
        x, x_norm, _ = grams.leaf(0, np.arange(6))
        y, y_norm = blocks._RightGrams(grams, b).counts(0, 6)
        assert np.allclose((x[i] * y[j]).sum(axis=1) / np.sqrt(x_norm[i] * y_norm[j]), cosine)
