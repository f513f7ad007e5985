"""Sharding by sampled splitters: shards of nearly equal bytes, cut from one range-partitioned order.

1. A sample of keys, each row drawn with a chance proportional to its size, gives quantile
   boundaries; every row finds its range by binary search in them.
2. Ranges that hold more than their share (a key with many rows, or a range that outgrows
   ``unit_bytes`` at scale) are subdivided by a hash, so no unit follows a hot key.
3. Inside each unit rows are ranked; units carry the bytes and rows before them, so each row
   knows its place in the whole order without a task that sees the whole order.
4. A row belongs to the shard its middle byte falls into. Two shards differ by less than the
   size of two rows.

The sample and the boundaries are bounded by ``sample_rows`` and ``ranges``; the rest is
DataFrame work over all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweld.llm.common import count_not_above, longs, whole_text
from tabweld.session import materialize

ROW_BYTES = 16


def keyed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32`` and the range ``key``.

    The key is a hash of the text, so equal texts are neighbours in the order.
    """
    text = whole_text(F.col(text_column))
    raw = F.encode(text, "UTF-8")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def drawn(rows: DataFrame, total: int, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows, each with a chance proportional to its size; equal rows are drawn one by one."""
    chance = F.shiftrightunsigned(F.xxhash64("written", "key", F.lit(17)), 11) / F.lit(float(1 << 53))
    return rows.where(chance * total < F.col("size") * sample_rows)


def sampled_boundaries(rows: DataFrame, total: int, ranges: int, sample_rows: int) -> list[int]:
    """At most ``ranges - 1`` ascending keys: quantiles of a sample weighted by size."""
    keys = drawn(rows, total, sample_rows).agg(F.sort_array(F.collect_list("key")).alias("k")).first().k
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def shard_by_bytes(
    rows: DataFrame,
    shards: int = 40,
    ranges: int = 512,
    sample_rows: int = 8192,
    unit_bytes: int = 64 << 20,
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to ``doc_id, size, text_crc32, key``.

    Every row is numbered when the rows are written (``written``), and the number parts equal rows:
    in the sample, between the parts of a range, and in their order. So rows that are repeated
    without end, or have no id, spread like others; where a row goes depends on the input's files.
    Null ids sort first. An empty table gives an empty result. No row is left out.
    """
    rows = materialize(rows.withColumn("written", F.monotonically_increasing_id()), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    boundaries = sampled_boundaries(rows, max(total, 1), ranges, sample_rows)
    ranged = rows.withColumn("range", count_not_above(boundaries, F.col("key")).cast("int"))

    # Ranges are at most `ranges` rows: their totals come to the driver.
    filled = {r["range"]: (r.b, r.n) for r in ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    share_b = min(max(1.0, 1.5 * total / (len(boundaries) + 1)), unit_bytes)
    share_n = max(1.0, 1.5 * count / (len(boundaries) + 1))
    parts, before_b, before_n, b_sum, n_sum = [], [], [], 0, 0
    for r in range(len(boundaries) + 1):
        b, n = filled.get(r, (0, 0))
        parts.append(max(1, math.ceil(b / share_b), math.ceil(n / share_n)))
        before_b.append(b_sum)
        before_n.append(n_sum)
        b_sum, n_sum = b_sum + b, n_sum + n

    part = F.pmod(F.xxhash64("written", "key", F.lit(29)), F.get(longs(parts), F.col("range")))
    ranged = ranged.withColumn("part", part)
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    units = ranged.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    units = units.select(
        "range",
        "part",
        (F.coalesce(F.sum("b").over(earlier), F.lit(0)) + F.get(longs(before_b), F.col("range"))).alias("bytes_before"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.get(longs(before_n), F.col("range"))).alias("rows_before"),
    )
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "written")
    ranked = ranged.withColumn("n", F.row_number().over(order)).withColumn(
        "b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    placed = ranked.join(units, ["range", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * (bytes_before + b) - size)) div {2 * max(total, 1)}")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("n") - 1).alias("rank"),
    )
    placed = materialize(placed, "shard-ranks")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    firsts = longs([first.get(s, 0) for s in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.get(firsts, F.col("shard"))).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write whole rows in one folder per shard, each ordered by slot; ids must be unique.

    Rows are dealt by (shard, run of slots), so that no task writes a whole shard at scale.
    """
    rows = docs.join(assigned.select(F.col("doc_id").alias(id_column), "shard", "slot"), id_column)
    run = F.expr("slot div 100000")
    rows.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
