import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions import similarity
from tabweld.functions.embed import embedder
from tabweld.functions.similarity import bigram_cosine, jaro_winkler, numeric_closeness, vector_cosine
from tabweld.functions.text import WHITESPACE, id_text, row_text, standardize
from tests import brute


def test_jaro_winkler_matches_textbook_form(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé ", k=rng.randint(0, 12))) for _ in range(400)]
    rows = [(a, b) for a, b in zip(words, reversed(words))] + [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", "")]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s"))
    for r in out.collect():
        assert r["s"] == pytest.approx(brute.jaro_winkler(r["a"], r["b"]), abs=1e-12), r


def test_known_jaro_winkler_values(spark):
    known = {("martha", "marhta"): 0.961111, ("dixon", "dicksonx"): 0.813333, ("josé", "jose"): 0.883333}
    rows = [(a, b, s) for (a, b), s in known.items()]
    out = spark.createDataFrame(rows, "a string, b string, want double")
    for r in out.withColumn("s", jaro_winkler(F.col("a"), F.col("b"))).collect():
        assert r["s"] == pytest.approx(r["want"], abs=1e-6)


def test_bigram_cosine_and_nulls(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("xyzß \n", k=rng.randint(0, 40))) for _ in range(300)]
    rows = list(zip(words, reversed(words))) + [(None, "a"), ("a", None)]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", bigram_cosine(F.col("a"), F.col("b")).alias("s"))
    for r in out.collect():
        if r["a"] is None or r["b"] is None:
            assert r["s"] is None
        else:
            assert r["s"] == pytest.approx(brute.bigram_cosine(r["a"], r["b"]), abs=1e-12)


def test_long_texts_are_compared_whole(spark):
    base = "lorem ipsum " * 20_000
    rows = [(base + "a", base + "b"), (base, base)]
    out = spark.createDataFrame(rows, "a string, b string")
    near, same = out.select(bigram_cosine(F.col("a"), F.col("b")), jaro_winkler(F.col("a"), F.col("b"))).collect()
    assert near[0] < 1.0 and near[1] < 1.0
    assert same[0] == pytest.approx(1.0) and same[1] == 1.0


def test_numeric_closeness(spark):
    rows = [(0.0, 0.0, 1.0), (10.0, 5.0, 0.5), (-1.0, 1.0, -1.0), (None, 1.0, None), (4.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, want double")
    for r in df.withColumn("s", numeric_closeness(F.col("a"), F.col("b"))).collect():
        assert r["s"] == r["want"]


def test_vector_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector_cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] == 0.0


def test_standardize_strips_all_unicode_whitespace(spark):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    rows = [(" John ",), ("JANE",), ("bob  ",), ("\t  É 　\n",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(standardize(F.col("s"))).collect()] == ["john", "jane", "bob", "é", None]


def test_id_text_is_the_same_for_whole_numbers_of_any_type(spark):
    df = spark.range(1).select(F.lit(7).alias("i"), F.lit(7.0).alias("d"), F.lit(" 7 ").alias("s"), F.lit(7.5).alias("f"))
    types = {f.name: f.dataType for f in df.schema}
    assert list(df.select(*[id_text(F.col(c), types[c]) for c in df.columns]).first()) == ["7", "7", "7", "7.5"]


def test_row_text_formats_and_repeats(spark):
    df = spark.createDataFrame([("A1 ", 0.125, True, None), ("b", 2.675, False, "X")], "user_id string, x double, ok boolean, note string")
    types = {f.name: f.dataType for f in df.schema}
    got = [r[0] for r in df.select(row_text([(c, F.col(c), types[c]) for c in df.columns])).collect()]
    assert got == [
        "user_id: a1 | user_id: a1 | user_id: a1 | x: 0.12 | ok: 1.00",
        "user_id: b | user_id: b | user_id: b | x: 2.67 | ok: 0.00 | note: x",
    ]


def test_embedder_loads_a_model_of_the_caller(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    embed = embedder(load)
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string").select(embed(F.col("t")).alias("v"))
    assert df.schema["v"].dataType == T.ArrayType(T.FloatType())
    assert [list(r["v"]) for r in df.collect()] == [[2.0, 1.0], [4.0, 1.0]]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aé😀 \n"])
def test_texts_measured_together_and_one_by_one(monkeypatch, alphabet):
    rng = random.Random(3)

    def texts(longest):
        return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(200)]

    a, b = texts(70) + texts(6), texts(70) + texts(6)
    want = [brute.jaro_winkler(x, y) for x, y in zip(a, b)]
    for rows in (0, 10**9):
        monkeypatch.setattr(similarity, "_BATCH_ROWS", rows)
        assert similarity._jaro_winklers(a, b).tolist() == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("cells, dense", [(4_000_000, 4), (4_000_000, 0), (1, 4)])
def test_cosines_of_repeated_texts(monkeypatch, cells, dense):
    monkeypatch.setattr(similarity, "_TABLE_SIZE", cells)
    monkeypatch.setattr(similarity, "_DENSE_FACTOR", dense)
    monkeypatch.setattr(similarity, "_CHARS_PER_STEP", 3_000)
    rng = random.Random(4)
    pool = ["", None] + ["".join(rng.choice("abc é😀") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    a, b = ([rng.choice(pool) for _ in range(500)] for _ in range(2))
    found = similarity._bigram_cosine_udf.func(pa.array(a, pa.string()), pa.array(b, pa.string())).to_pylist()
    for x, y, cosine in zip(a, b, found):
        assert cosine == (None if x is None or y is None else pytest.approx(brute.bigram_cosine(x, y), abs=1e-12))
