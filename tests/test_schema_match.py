import pytest
from pyspark.sql import functions as F

from tabweld import match_schemas
from tabweld.operators.schema_match import catalog, expand_name, match_catalogs, schema_matches, unmatched_columns
from tests import brute

WORDS = ((("id",), " identifier primary key"), (("age", "years"), " age in years numeric"), (("name",), " person name text"))


def table(spark, *names):
    return spark.range(1).select(*[F.lit(1).alias(n) for n in names])


def expanded(name):
    text = name.lower().replace("_", " ")
    for words, context in WORDS:
        if any(w in text for w in words):
            text += context
    return text


def test_names_are_expanded_in_order(spark):
    names = ["user_id", "First_Name", "paid_pages", "city", "video"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(expand_name(F.col("n"))).collect()] == [expanded(n) for n in names]


def test_exact_columns(spark):
    got = match_schemas(table(spark, "user_id", "name", "age"), table(spark, "user_id", "name"))
    assert got == {"user_id": "user_id", "name": "name"}


@pytest.mark.parametrize(
    "left, right, want",
    [
        (["user_id", "first_name", "age_in_years"], ["userid", "fname", "age"], {"user_id": "userid", "first_name": "fname", "age_in_years": "age"}),
        (["user_id", "name", "age"], ["userid", "full_name", "age_years"], {"user_id": "userid", "name": "full_name", "age": "age_years"}),
        (
            ["customer_id", "email", "city", "total_purchases"],
            ["cust_id", "email", "city", "purchases"],
            {"customer_id": "cust_id", "email": "email", "city": "city", "total_purchases": "purchases"},
        ),
        (["abc"], ["xyz"], {}),
    ],
)
def test_similar_columns(spark, left, right, want):
    assert match_schemas(table(spark, *left), table(spark, *right)) == want


def test_a_taken_column_gives_no_second_choice(spark):
    left, right = table(spark, "name", "names", "city"), table(spark, "name", "town")
    assert match_schemas(left, right) == {"name": "name"}
    matches = schema_matches(left, right).withColumn("pair", F.lit(0))
    alone = unmatched_columns(catalog(left), matches, "left", ["pair"])
    assert {r["column_name"] for r in alone.collect()} == {"names", "city"}


def test_many_pairs_at_once_equal_one_at_a_time(spark):
    pairs = {
        1: (["user_id", "name", "age"], ["age_years", "full_name", "userid"]),
        2: (["a_name", "b_name", "c_name"], ["c_name", "a_name"]),
    }
    rows = [[(p, i, n) for p, lists in pairs.items() for i, n in enumerate(lists[k])] for k in (0, 1)]
    left, right = (spark.createDataFrame(r, "pair int, position int, column_name string") for r in rows)
    got = {(r["pair"], r["left_column"]): r["right_column"] for r in match_catalogs(left, right, ["pair"]).collect()}
    want = {}
    for p, (a, b) in pairs.items():
        taken = set()
        for x in a:
            scores = [0.7 * brute.bigram_cosine(expanded(x), expanded(y)) + 0.3 * brute.jaro_winkler(x, y) for y in b]
            best = scores.index(max(scores))
            if scores[best] >= 0.6 and best not in taken:
                taken.add(best)
                want[(p, x)] = b[best]
    assert got == want


def test_vectors_of_a_model_replace_the_bigrams(spark):
    def embed(text):
        return F.when(F.contains(text, F.lit("cost")) | F.contains(text, F.lit("price")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(
            F.array(F.lit(0.0), F.lit(1.0))
        )

    assert match_schemas(table(spark, "cost"), table(spark, "zip", "price"), embed) == {"cost": "price"}
