import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, code long, line string, n int, slot long, `a.b` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "one two",
        "a b c d e f g",
        "a b c d e f g",
        "tab\tand\x0bfeed\r\n\n\nÄÖ ß 日本語 \u2581 🎉",
        long,
        long + " end",
        "\n".join(["Same line here.", "Another line of text, quite plain."] * 40),
        "!" * 5000,
        "x" * 40_000,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "row", i, "l", 1, 2, "dot") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None,) * 11, (99, "only a text", None, None, None, None, None, None, None, None, None), (None, "a b c d e f g", "en", None, 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
