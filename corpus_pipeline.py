"""The corpus pipeline: stages over ``documents``, each written as Parquet before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweld.llm import line_dedup, mixing, pieces, quality, queries, simhash
from tabweld.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality.good_documents(docs)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share."""
    return line_dedup.without_boilerplate(docs).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked by 2 or fewer bits."""
    return simhash.deduplicated(docs, max_bits=2, shingle=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mixture of their sources by smoothed sizes."""
    return mixing.in_mixed_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to its text, and its place in the mixture."""
    placed = mixing.with_position(docs.select("doc_id", "text"))
    encoded = pieces.encoded(placed.select(F.struct("doc_id", "position").alias("id"), "text"), queries.vocabulary(), "id")
    return encoded.select("doc_id.doc_id", "token_ids", "round_trip", "doc_id.position")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", remove_boilerplate),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The last stage's token ids have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
