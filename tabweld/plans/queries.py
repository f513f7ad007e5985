"""The registered queries: each operator over whole bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweld.functions.embed import embed_distinct, embedder
from tabweld.functions.similarity import bigram_cosine, jaro_winkler, numeric_closeness, vector_cosine
from tabweld.functions.text import id_text, row_text
from tabweld.operators import columns as cols
from tabweld.operators.clean import clean_data, standardize_strings
from tabweld.operators.content_match import content_matches
from tabweld.operators.evaluate import evaluate_pairs
from tabweld.operators.golden import golden_records
from tabweld.operators.impute import impute_missing_values
from tabweld.operators.metric_join import near_vectors as vectors_within
from tabweld.operators.profile import column_profile, match_table, merge_statistics, shapes
from tabweld.operators.row_index import with_content_index, with_row_index
from tabweld.operators.schema_match import (
    catalog,
    expand_name,
    match_catalogs,
    match_schemas,
    schema_matches,
    unmatched_columns,
)
from tabweld.operators.scoring import RowScore, plan_fields
from tabweld.plans.fixtures import RIGHT, left_table, right_table, sql, table
from tabweld.plans.merge import ROW_THRESHOLD, match_datasets, merge_datasets, preprocess_datasets
from tabweld.session import new_path
from tabweld.sources.files import read_csv, read_json, write_csv, write_json
from tabweld.sources.sqlite import export_to_sqlite, read_sqlite
from tabweld.sources.tables import export_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Order facts with gaps, for imputation.
GAPS = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_quantity AS INT) END AS quantity,
  CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS flag
FROM lineitem
"""

# Order facts with gaps in columns of exact decimals.
DECIMAL_GAPS = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(15, 2)) END AS price,
  CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_discount AS DECIMAL(4, 2)) END AS discount
FROM lineitem
"""

# Orders under names like those of the customer table: many rows per identifier.
ORDER_SIDE = """
SELECT o_orderkey AS order_no, o_custkey AS customer_id, c_name AS name,
  round(c_acctbal + o_totalprice / 100000, 2) AS balance
FROM orders JOIN customer ON o_custkey = c_custkey
"""
CUSTOMER_SIDE = "SELECT c_custkey AS cust_id, c_name AS full_name, c_acctbal AS acct_balance FROM customer"

# Two logs of the same events: many rows per identifier on both sides.
LOG_A = "SELECT event_id AS entry, user_id, event_type AS action, value AS amount FROM events"
LOG_B = """
SELECT event_id AS line, user_id AS userid, upper(event_type) AS action_name,
  CASE WHEN event_type = 'error' THEN value * 3 ELSE value END AS amount_paid FROM events
"""


# The same pages by two spellings of their addresses: texts alone.
ADDRESS_A = "SELECT page_id AS page, url AS link FROM pages"
ADDRESS_B = "SELECT page_id AS place, replace(replace(url, 'https://', 'http://'), '.example.', '.exampel.') AS address FROM pages"

# The same customers by six numbers and no identifier; some numbers differ a little.
NUMBERS_A = """
SELECT c_custkey AS row_no, c_acctbal AS a, c_nationkey + 1 AS b, c_custkey % 97 + 1 AS c, c_custkey % 89 + 1 AS d,
  c_custkey % 83 + 1 AS e, c_custkey % 79 + 1 AS f FROM customer
"""
NUMBERS_B = """
SELECT c_custkey AS pos, c_acctbal AS aa, c_nationkey + 1 AS bb, c_custkey % 97 + 1 AS cc,
  c_custkey % 89 + 1 + c_custkey % 2 AS dd, c_custkey % 83 + 1 AS ee, c_custkey % 79 + 1 AS ff
FROM customer
"""


# Customers under names that tell nothing; the right columns are in another order.
CONTENT_A = "SELECT c_custkey AS a0, concat(' ', c_name, ' ') AS a1, c_acctbal AS a2, c_nationkey AS a3, c_mktsegment AS a4 FROM customer"
CONTENT_B = (
    "SELECT source_tag AS b0, mkt_segment AS b1, CAST(nation_key AS DOUBLE) AS b2, cust_id AS b3, full_name AS b4, acct_balance AS b5 "
    f"FROM ({RIGHT}) x"
)


def _customers(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    left, right = left_table(spark, sf_dir), right_table(spark, sf_dir)
    merged, stats = merge_datasets(left, right, left_key="customer_id", right_key="cust_id", **options)
    return merged, stats, left, right


def _customer_matches(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    left, right = left_table(spark, sf_dir), right_table(spark, sf_dir)
    return match_datasets(left, right, left_key="customer_id", right_key="cust_id"), left, right


def merge_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir)[0]


def merge_customers_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir, similarity_threshold=0.8, align_both=True)[0]


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_table(_customer_matches(spark, sf_dir)[0]["matched_pairs"])


def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, left, right = _customer_matches(spark, sf_dir)
    return merge_statistics(stats["matched_pairs"], left, right, len(stats["schema_matches"]))


def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall against the truth: the same customer under the same identifier."""
    pairs = _customer_matches(spark, sf_dir)[0]["matched_pairs"]
    truth = sql(
        spark, sf_dir, "SELECT c_custkey AS left_id, c_custkey AS right_id FROM customer WHERE c_nationkey >= 5", "customer"
    )
    scores = evaluate_pairs(pairs, truth)
    return scores.select("predicted", "actual", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def golden_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, left, right = _customer_matches(spark, sf_dir)
    return golden_records(left, right, stats["matched_pairs"], stats["schema_matches"], "customer_id", "cust_id")


def orders_to_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sql(spark, sf_dir, ORDER_SIDE, "orders", "customer")
    right = sql(spark, sf_dir, CUSTOMER_SIDE, "customer")
    stats = match_datasets(
        left, right, left_key="order_no", right_key="cust_id",
        schema_matches={"customer_id": "cust_id", "name": "full_name", "balance": "acct_balance"},
    )
    return match_table(stats["matched_pairs"])


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sql(spark, sf_dir, LOG_A, "events"), sql(spark, sf_dir, LOG_B, "events")
    stats = match_datasets(
        left, right, left_key="entry", right_key="line",
        schema_matches={"user_id": "userid", "action": "action_name", "amount": "amount_paid"},
    )
    return match_table(stats["matched_pairs"])


def customers_to_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No identifier on either side: numbers bound the pairs."""
    left, right = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    stats = match_datasets(left, right, 0.8, left_key="c_custkey", right_key="s_suppkey")
    return stats["matched_pairs"].select("left_id", "right_id", F.round("score", 6).alias("match_score"))


def pages_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts alone on both sides: their bigrams bound the pairs."""
    left, right = sql(spark, sf_dir, ADDRESS_A, "pages"), sql(spark, sf_dir, ADDRESS_B, "pages")
    stats = match_datasets(left, right, left_key="page", right_key="place", schema_matches={"link": "address"})
    return stats["matched_pairs"].select("left_id", "right_id", F.round("score", 6).alias("match_score"))


def customers_by_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six numbers and no identifier: too many for their ratios to bound the pairs."""
    left, right = sql(spark, sf_dir, NUMBERS_A, "customer"), sql(spark, sf_dir, NUMBERS_B, "customer")
    stats = match_datasets(left, right, left_key="row_no", right_key="pos", schema_matches={c: c * 2 for c in "abcdef"})
    return stats["matched_pairs"].select("left_id", "right_id", F.round("score", 6).alias("match_score"))


def keyless_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of the customer tables without keys: positions follow what the rows hold."""
    return merge_datasets(left_table(spark, sf_dir), right_table(spark, sf_dir))[0]


def verified_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge whose result is scanned for nulls before it is returned."""
    return _customers(spark, sf_dir, verify=True)[0]


def preprocessed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left side as the preprocessing of both tables leaves it."""
    return preprocess_datasets(left_table(spark, sf_dir), right_table(spark, sf_dir))[0]


def field_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field score, cosine and their mix for each customer under equal identifiers."""
    left, right = left_table(spark, sf_dir), right_table(spark, sf_dir)
    matches = match_schemas(left, right)
    row_score = RowScore(plan_fields(left.schema, right.schema, matches), ROW_THRESHOLD)
    a = row_score.prepare(impute_missing_values(standardize_strings(left)), "customer_id", "left")
    b = row_score.prepare(impute_missing_values(standardize_strings(right)), "cust_id", "right")
    scored = row_score.with_score(a.join(b, F.col("l0") == F.col("r0")))
    return scored.select("left_id", *[F.round(c, 6).alias(c) for c in ("field_score", "cosine", "score")])


def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = impute_missing_values(standardize_strings(left_table(spark, sf_dir)))
    types = {f.name: f.dataType for f in df.schema}
    return df.select("customer_id", row_text([(c, F.col(c), types[c]) for c in df.columns]).alias("row_text"))


def text_row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a text identifier, whose part is repeated."""
    df = sql(spark, sf_dir, "SELECT o_orderkey, concat('ORD-', o_orderkey) AS order_id, o_orderpriority, o_totalprice FROM orders", "orders")
    types = {f.name: f.dataType for f in df.schema}
    return df.select("o_orderkey", row_text([(c, F.col(c), types[c]) for c in df.columns[1:]]).alias("row_text"))


def id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("key_number", F.col("o_orderkey").cast("double"))
    df = df.withColumn("status", F.concat(F.lit("\t "), "o_orderstatus", F.lit(" \n")))
    types = {f.name: f.dataType for f in df.schema}
    return df.select("o_orderkey", *[id_text(F.col(c), types[c]).alias(f"{c}_text") for c in ("key_number", "o_totalprice", "o_custkey", "status")])


def part_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    pairs = {"name_type": ("p_name", "p_type"), "name_brand": ("p_name", "p_brand"), "brand_type": ("p_brand", "p_type")}
    scores = [F.round(jaro_winkler(F.lower(a), F.lower(b)), 6).alias(n) for n, (a, b) in pairs.items()]
    return df.select("p_partkey", *scores)


def turn_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the next one, whole texts."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    both = turns.join(following, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(bigram_cosine(F.col("text"), F.col("next_text")), 6).alias("cosine"))


def document_label_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each whole document with its source and language names."""
    df = table(spark, sf_dir, "documents")
    tag = F.concat_ws(" ", "lang", "source")
    return df.select("doc_id", F.round(bigram_cosine(F.col("text"), tag), 6).alias("cosine"))


def price_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    near = numeric_closeness(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    balance = numeric_closeness(F.col("l_discount"), F.col("l_tax"))
    return both.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(near), 6).alias("price_closeness"), F.round(F.avg(balance), 6).alias("rate_closeness")
    )


def vector_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding with the mean vector of its label, which is aggregated per dimension."""
    df = table(spark, sf_dir, "embeddings")
    cells = df.select("label", F.posexplode("embedding").alias("place", "x"))
    means = cells.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("cells"))
    centers = listed.select("label", F.transform("cells", lambda c: c["m"]).alias("center"))
    both = df.join(centers, "label")
    return both.select("vec_id", F.round(vector_cosine(F.col("embedding"), F.col("center")), 6).alias("cosine"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of an embedding and an embedding rounded to one decimal whose cosine is at least 0.975."""
    rows = table(spark, sf_dir, "embeddings")
    left = rows.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("left_vector"))
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    right = rows.select(F.col("vec_id").alias("right_id"), rounded.alias("right_vector"))
    return vectors_within(left, right, 0.975).select("left_id", "right_id", F.round("cosine", 6).alias("cosine"))


def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors of a small model that counts characters, each distinct text embedded once."""

    def load():
        def encode(texts):
            return [[len(t), t.count(" "), t.count("\n"), t.count("e") + t.count("a")] for t in texts]

        return encode

    rows = embed_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", embedder(load))
    names = ("n_chars", "n_spaces", "n_breaks", "n_vowels")
    return rows.select("doc_id", *[F.col("vector")[i].cast("bigint").alias(n) for i, n in enumerate(names)])


def schema_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched columns with the number of values on each side."""
    left, right = left_table(spark, sf_dir), right_table(spark, sf_dir)
    a = column_profile(left).select(F.col("column_name").alias("left_column"), F.col("non_null").alias("left_values"))
    b = column_profile(right).select(F.col("column_name").alias("right_column"), F.col("non_null").alias("right_values"))
    matches = schema_matches(left, right)
    return (
        matches.join(a, "left_column")
        .join(b, "right_column")
        .select("left_column", "right_column", F.round("score", 6).alias("score"), "left_values", "right_values")
    )


def unmatched_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without a partner, both sides, with their number of values."""
    left, right = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    matches = schema_matches(left, right).withColumn("pair", F.lit(0))
    out = []
    for side, df in (("left", left), ("right", right)):
        alone = unmatched_columns(catalog(df), matches, side, ["pair"])
        values = column_profile(df).select("column_name", "non_null")
        out.append(alone.join(values, "column_name").select(F.lit(side).alias("side"), "column_name", "non_null"))
    return out[0].unionByName(out[1])


def shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pair of tables shares a column name, with the number of rows behind it."""
    rows = []
    for a, b in (("documents", "labels"), ("documents", "conversations"), ("customer", "supplier"), ("documents", "benchmark")):
        left, right = table(spark, sf_dir, a), table(spark, sf_dir, b)
        shares = cols.validate_schema_compatibility(left, right)
        both = left.select(F.lit(1)).unionAll(right.select(F.lit(1))).agg(F.count(F.lit(1)).alias("n_rows"))
        rows.append(both.select(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), F.lit(shares).alias("compatible"), "n_rows"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def catalog_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of many table pairs at once: per brand, part names in two spellings."""
    parts = table(spark, sf_dir, "part")

    def side(name):
        names = parts.select("p_brand", name.alias("column_name")).distinct()
        counted = names.groupBy("p_brand").agg(F.sort_array(F.collect_set("column_name")).alias("names"))
        return counted.select("p_brand", F.posexplode("names").alias("position", "column_name"))

    left = side(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    right = side(F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))))
    return match_catalogs(left, right, ["p_brand"]).select(
        "p_brand", "left_column", "right_column", F.round("score", 6).alias("score")
    )


def content_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with useless names, matched by what they hold."""
    left, right = sql(spark, sf_dir, CONTENT_A, "customer"), sql(spark, sf_dir, CONTENT_B, "customer")
    return content_matches(left, right).select("left_column", "right_column", F.round("score", 6).alias("score"))


def expanded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", expand_name(name).alias("words"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_data(table(spark, sf_dir, "documents").select("text", "lang"))


def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest id of each distinct text."""
    distinct = clean_data(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return distinct.select("doc_id", F.length("text").alias("n_chars"))


def impute_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_missing_values(standardize_strings(left_table(spark, sf_dir)))


def impute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_missing_values(sql(spark, sf_dir, GAPS, "lineitem"))


def impute_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of decimals, with a digit more than the columns."""
    rows = impute_missing_values(sql(spark, sf_dir, DECIMAL_GAPS, "lineitem"))
    milli = [(F.col(c) * 1000).cast("bigint").alias(f"{c}_milli") for c in ("price", "discount")]
    return rows.select("l_orderkey", "l_linenumber", *milli)


def impute_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without any value: 0 for numbers, empty text for text."""
    df = cols.add_text_column(table(spark, sf_dir, "orders"), "note").withColumn("weight", F.lit(None).cast("double"))
    return impute_missing_values(df.select("o_orderkey", "note", "weight"), number_default=0.0)


def nulls_after_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = column_profile(impute_lines(spark, sf_dir))
    return profile.select("column_name", "non_null", "nulls")


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(sql(spark, sf_dir, GAPS, "lineitem"))


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(merge_customers(spark, sf_dir)).select("column_name", "non_null", "nulls", "null_percent")


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes({name: table(spark, sf_dir, name) for name in TABLES})


def indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return with_row_index(orders, "row_id", ["o_totalprice", "o_orderkey"])


def content_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of rows without a key, most of which have copies."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return with_content_index(lines)[0]


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    messy = df.select(
        F.col("o_orderkey").alias(" Order Key"), F.col("o_custkey").alias("Cust-Key "), F.col("o_totalprice").alias("TOTAL-price paid")
    )
    return cols.clean_column_names(messy)


def dropped_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cols.drop_column(cols.add_text_column(table(spark, sf_dir, "supplier"), "remark"), "s_acctbal")


def exported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") > 200000)
    return cols.export_casts(df.select("o_orderkey", "o_orderstatus", "big"))


def listed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the order table's columns with their distinct-free value counts."""
    orders = table(spark, sf_dir, "orders")
    values = column_profile(orders).select("column_name", "non_null")
    return cols.column_types(orders).join(values, "column_name")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first 20 rows."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return cols.preview(events, "event_id", 20)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = left_table(spark, sf_dir), new_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path)


def csv_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that look like numbers with an ending come back as texts."""
    df = sql(spark, sf_dir, "SELECT p_partkey, concat(p_size, CASE WHEN p_size % 2 = 0 THEN 'D' ELSE 'f' END) AS code FROM part", "part")
    path = new_path(spark, "codes")
    write_csv(df, path)
    return read_csv(spark, path)


def exported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a checked table export, with the table read back."""
    orders, path = table(spark, sf_dir, "orders"), new_path(spark, "orders")
    rows = export_table(orders, path)
    back = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last"))
    return back.withColumn("rows", F.lit(rows))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = left_table(spark, sf_dir), new_path(spark, "json")
    write_json(df, path)
    return read_json(spark, path, df.schema)


def sqlite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    df = df.withColumn("big", F.col("o_totalprice") > 200000)
    path = new_path(spark, "sqlite")
    export_to_sqlite(df, path, "orders")
    return read_sqlite(spark, path, "orders")


QUERIES = {
    f.__name__: f
    for f in (
        merge_customers, merge_customers_aligned, matched_pairs, match_statistics, match_quality, golden_customers,
        orders_to_customers, event_logs, customers_to_suppliers, pages_by_address, customers_by_numbers,
        verified_merge, keyless_merge, preprocessed_customers, csv_codes, exported_orders, field_similarity, row_texts, text_row_texts, id_texts,
        part_spelling, turn_cosines, document_label_cosines, price_closeness, vector_cosines, near_vectors, text_embeddings, schema_match_report,
        unmatched_column_report, shared_columns, catalog_matches, content_columns, expanded_names, clean_documents, first_copies,
        impute_customers, impute_lines, impute_decimals, impute_empty_columns, nulls_after_imputation, profile_lines, profile_merged,
        table_shapes, indexed_orders, content_positions, renamed_columns, dropped_column, exported_types, listed_columns, latest_events,
        csv_round_trip, json_round_trip, sqlite_round_trip,
    )
}
