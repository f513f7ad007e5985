"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweld.llm import alignment, decontaminate, line_dedup, mixing, periodic, pieces, pii, quality, sharding, simhash, suffix_dedup, topk, url_filter

#: For tests and benchmarks; a real run takes its key from a secret store.
PII_KEY = "corpus-key-1"
URL_ALLOW = ("org/", "com/fr/")
URL_BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sites share."""
    rows = line_dedup.without_boilerplate(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_removed", "row.n_chars", "row.text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that also start elsewhere."""
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"), length=400, with_text=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data and secrets."""
    rows = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return rows.select("row.doc_id", "row.text", F.size("found").alias("n_found"), F.array_join("found", " ").alias("kinds"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    rows = sharding.keyed_rows(table(spark, sf_dir, "documents"))
    return sharding.shard_by_bytes(rows, shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the longest rule that fits its URL."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_ALLOW, URL_BLOCK)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def vocabulary(path: str | None = None) -> pieces.Vocabulary:
    """The public 32k model, wherever it is installed; another model's path may be given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.read_vocabulary(path, "bpe")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return pieces.encoded(table(spark, sf_dir, "documents"), vocabulary())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture of the sources by smoothed sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs).select("row.doc_id", "source", "phase", "block", "release", "deadline", "slot", "place")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.with_components(simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=3), max_bits=2)
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_pair(byte_bpe: str | None = None, piece_model: str | None = None) -> alignment.Pair:
    """The two public tokenizers, wherever they are installed; other files may be given."""
    if byte_bpe is None or piece_model is None:
        import public_tokenizers

        byte_bpe = byte_bpe or public_tokenizers.path("byte_bpe_50k.json")
        piece_model = piece_model or public_tokenizers.path("piece_bpe_32k.model")
    return alignment.read_pair(byte_bpe, piece_model)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, weighed by the documents that hold a pair."""
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_pair())[1]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which continue with a period from some word on."""
    return periodic.report(periodic.with_planted_periods(table(spark, sf_dir, "documents")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark items, by windows of 10 words."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_top_k": op5_top_k,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontamination": op13_decontamination,
}
