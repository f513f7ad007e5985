"""Line dedup, quality rules and URL filters against SQL and on odd input."""

import duckdb
import pytest

from tabweld.llm import line_dedup, oracles, quality, queries, url_filter

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "embeddings", "pages")


def compare(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    shape = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert shape(got) == shape(want)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name)


def test_lines_shared_by_sites_go(spark):
    own = [f"own paragraph number {i} with its own words" for i in range(30)]
    rows = [(i, f"Home | About\n{own[i]}\n\nAll rights reserved.", f"site{i % 12}") for i in range(30)]
    # Copies of one page on many sites keep their lines: they share their signature.
    rows += [(100 + i, "a page that was copied\nto many sites as it is", f"site{i}") for i in range(12)]
    rows += [(200 + i, f"rare line\nwords only here {i}", "site1") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_boilerplate(docs).select("row.doc_id", "row.text", "n_removed").collect()}
    assert all(out[i] == (f"{own[i]}\n", 2) for i in range(30))
    assert all(out[100 + i][1] == 0 and out[200 + i][1] == 0 for i in range(12))


def removed_lines(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    return {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_boilerplate(docs).select("row.doc_id", "row.text", "n_removed").collect()}


def test_copies_do_not_hide_boilerplate(spark):
    rows = [(i, f"own words of page {i}\nShared footer", f"site{i % 12}") for i in range(40)]
    # A group of copies with the same footer: the footer goes, the copied words stay.
    rows += [(100 + i, "a page that was copied to many sites\nShared footer", f"site{i % 12}") for i in range(120)]
    out = removed_lines(spark, rows)
    assert all(out[i] == (f"own words of page {i}", 1) for i in range(40))
    assert all(out[100 + i] == ("a page that was copied to many sites", 1) for i in range(120))


def test_long_boilerplate_over_short_lines(spark):
    """Two shared paragraphs longer than every own line do not make the pages copies of each other."""
    notice = "We use cookies on this page and on all the others, and so do the companies that we work with."
    legal = "All rights reserved; no part of this page may be copied without the consent of its publisher in writing."
    rows = [(i, f"{notice}\nshort {i}\nlines {i}\n{legal}", f"site{i % 15}") for i in range(60)]
    rows += [(100 + i, f"a copied page\n{notice}\n{legal}", f"site{i}") for i in range(15)]
    out = removed_lines(spark, rows)
    assert all(out[i] == (f"short {i}\nlines {i}", 2) for i in range(60))
    assert all(out[100 + i] == ("a copied page", 2) for i in range(15))


def test_mirrored_pages_lose_their_footer(spark):
    """Every page is on every site, so no page has a line of its own."""
    rows = [(100 * i + k, f"the words of page {i}\nShared footer", f"site{k}") for i in range(20) for k in range(12)]
    assert all(x == (f"the words of page {i // 100}", 1) for i, x in removed_lines(spark, rows).items())


def test_lines_near_the_threshold_are_counted(spark):
    rows = [(1000 * k + i, f"line on {k} sites\nother {k} {i}", f"site{i}") for k in range(7, 14) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = line_dedup.without_boilerplate(docs).groupBy((line_dedup.F.expr("row.doc_id div 1000")).alias("k")).agg(line_dedup.F.sum("n_removed").alias("n"))
    assert {r.k: r.n for r in out.collect()} == {k: (k if k >= 10 else 0) for k in range(7, 14)}


def test_line_dedup_of_odd_docs(odd_docs, no_docs):
    out = line_dedup.without_boilerplate(odd_docs).select("row.*")
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    assert sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))
    assert line_dedup.without_boilerplate(no_docs).count() == 0
    some = line_dedup.without_boilerplate(odd_docs, min_sites=1).select("row.text", "n_removed", "n_lines")
    assert {r.text.strip("\n\t\r ") for r in some.where("n_removed > 0").collect()} == {""}


def test_quality_of_odd_docs(odd_docs, no_docs):
    out = {r.doc_id: r for r in quality.report(odd_docs).collect()}
    assert (out[0].n_words, out[0].n_lines, out[0].base_failed, out[0].kept) == (0, 0, True, False)
    assert (out[7].n_words, out[7].word_chars) == (8, 18)
    assert out[8].n_repeat_words == 30_000 and out[8].base_failed
    assert out[10].n_dup_lines == 78
    assert out[11].n_symbols == 0 and out[11].n_exclaim == 5000
    assert quality.good_documents(odd_docs).columns == odd_docs.columns
    assert quality.report(no_docs).count() == 0 and quality.good_documents(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "repeats"),
    [("a b c a b c", 6), ("a b c d a b c", 6), ("x x x x", 4), ("x x x", 0), ("a b", 0), ("a b c d e f", 0), ("a b c a b d a b c", 6)],
)
def test_repeated_words(spark, text, repeats):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert quality.measured(docs).first().n_repeat_words == repeats


def test_rules_are_learned(spark):
    """Junk that most rules miss goes, because the rule that sees it proves exact."""
    clean = [(i, " ".join(f"word{(i * 37 + j * 11) % 997}," if j % 9 == 0 else f"word{(i * 91 + j * j) % 1009}" for j in range(120))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{(i * 13 + j * j) % 899}### and," if j % 5 == 0 else f"w{(i * 7 + j * 17) % 911}$$$" for j in range(120))) for i in range(20)]
    out = {r.doc_id: r.kept for r in quality.report(spark.createDataFrame(clean + junk, "doc_id int, text string")).collect()}
    assert all(out[i] for i, _ in clean)
    assert not any(out[i] for i, _ in junk)


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    out = quality.report(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count()
    assert all((r.quality == 1) == r.kept for r in out.collect())


def test_urls(spark, no_docs):
    urls = [
        None, "", "no scheme/en/1", "http://Example.ORG/en/12?x", "https://a.b.example.org/es/", "http://notexample.org/es/x", "http://x.com/fr/1",
        "http://x.com/de/1#a", "http://x.com", "http://org", "http://org/", "a://b://c.org/x", "http://EXAMPLE.org/es?/es/", "http://x.com/FR/",
        "ftp://u@h.com:80/fr/", "http://.org/x", "://org/",
    ]
    pages = spark.createDataFrame([(i, u, "row", "k") for i, u in enumerate(urls)], "page_id int, url string, rule string, keys string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_ALLOW, queries.URL_BLOCK).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None, "allow")
    assert out[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[4][2:] == ("example.org/es/", "block") and out[5][2:] == ("org/", "allow")
    assert out[6][2:] == ("com/fr/", "allow") and out[7][2:] == ("com/de/", "block") and out[8][1:] == ("", None, "allow")
    assert out[9][2] is None and out[10][2] == "org/" and out[11] == ("b:", "//c.org/x", None, "allow")
    assert out[12] == ("example.org", "/es", "org/", "allow") and out[13][2] is None and out[14][2] is None
    assert out[15][2] == "org/" and out[16][2] == "org/"
    assert url_filter.judge_urls(pages.where("false"), queries.URL_ALLOW, queries.URL_BLOCK).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], [], "block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('key', id) AS key")
    listed = spark.range(0, 24_000, 31).selectExpr("concat('key', id) AS key")
    cascade = url_filter.build_cascade(listed, universe, 20_000)
    assert len(cascade) > 2
    found = universe.where(url_filter.is_listed(url_filter.F.col("key"), cascade))
    assert {r.key for r in found.collect()} == {f"key{i}" for i in range(0, 20_000, 31)}
    assert sum(len(level.words) for level in cascade) * 64 < 20_000
    with pytest.raises(ValueError):
        limit, url_filter.MOST_LISTED = url_filter.MOST_LISTED, 3
        try:
            url_filter.build_cascade(listed, universe, 20_000)
        finally:
            url_filter.MOST_LISTED = limit


def test_rates_are_estimated(spark):
    """Four rules or more get rates of their own, from votes that were not written before; clean documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    votes = quality.voted(quality.measured(docs)).withColumn("base_failed", quality.base_failed())
    trust = quality.learn_trust(votes)
    bad = {r: 1 - x for r, x in zip(quality.RULES, trust.on_bad)}
    good = {r: 1 - x for r, x in zip(quality.RULES, trust.on_good)}
    assert sum(bad[r] > 0.1 for r in bad) >= 4 and all(good[r] < 0.02 for r in good)
    assert bad["symbols"] > 0.9 > bad["word_length"] > bad["stops"] > good["stops"]


def test_nothing_goes_from_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("not text rlike '[#*$%&|<>]'")
    assert quality.report(docs).where("not base_failed and not kept").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_trust_is_that_of_plain_em(spark, seed):
    """The fold over patterns against EM over the documents themselves."""
    import random

    rng = random.Random(seed)
    rows = [tuple(rng.choice((-1, 1, 1, 0) if i % 5 else (-1, -1, 1, 0)) for _ in quality.RULES) + (i % 11 == 0,) for i in range(300)]
    votes = spark.createDataFrame(rows, ", ".join(f"vote_{r} int" for r in quality.RULES) + ", base_failed boolean")
    share, up = quality.FIRST_SHARE, {"good": [quality.FIRST_GOOD] * len(quality.RULES), "bad": [1 - quality.FIRST_BAD] * len(quality.RULES)}
    left = [r[:-1] for r in rows if not r[-1]]
    for _ in range(5):
        chance = []
        for r in left:
            good, bad = share, 1 - share
            for v, a, b in zip(r, up["good"], up["bad"]):
                good, bad = (good * a, bad * b) if v == 1 else (good * (1 - a), bad * (1 - b)) if v == -1 else (good, bad)
            chance.append(good / (good + bad))
        share = min(max(sum(chance) / len(left), quality.SHARES[0]), quality.SHARES[1])
        for kind, weights in (("good", chance), ("bad", [1 - c for c in chance])):
            sums = [[1 + sum(w for w, r in zip(weights, left) if r[j] == v) for v in (1, -1)] for j in range(len(quality.RULES))]
            up[kind] = [a / (a + b) for a, b in sums]
    trust = quality.learn_trust(votes, rounds=5)
    assert trust.share == pytest.approx(share) and trust.on_good == pytest.approx(up["good"]) and trust.on_bad == pytest.approx(up["bad"])
