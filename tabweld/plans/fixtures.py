"""Input tables of the registered queries, derived from whole bundled tables.

The SQL runs unchanged in Spark and in the engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Customers under one naming, with missing balances and segments.
LEFT = """
SELECT c_custkey AS customer_id, concat(' ', c_name, ' ') AS name,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance,
  c_nationkey AS nation,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment
FROM customer
"""

# The same customers under another naming, values changed; some under another identifier.
RIGHT = """
SELECT CASE WHEN c_nationkey < 5 THEN -1 - c_custkey ELSE c_custkey END AS cust_id,
  upper(c_name) AS full_name,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE round(c_acctbal + (c_nationkey - 12) / 4.0, 2) END AS acct_balance,
  c_nationkey AS nation_key, lower(c_mktsegment) AS mkt_segment,
  concat('nation ', c_nationkey) AS source_tag
FROM customer
"""


def sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """Run ``query`` with the named bundled tables as views."""
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(query)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def left_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LEFT, "customer")


def right_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RIGHT, "customer")
