"""Row positions and ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row within a partition in these bits
CHUNK = 1_000_000
COPIES_AT_ONCE = 100_000
_BUCKET_DIGITS = 4  # hexadecimal digits of the content's digest: 65,536 buckets of nearly equal size
_OWN = ("_content", "_bucket", "_copies", "_upto", "_before", "_piece")


def with_row_index(df: DataFrame, name: str = "row_id", order_by: list[str] | None = None) -> DataFrame:
    """Add positions 0..n-1, in scan order or in the order of the given unique columns.

    The rows are written once with their partition and place in it; the offsets come
    from one count per partition, so no step sees more than one partition's rows.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_place", _LOCAL_BITS)
    counts = placed.groupBy(part.alias("_part")).count()
    # One row per partition of the table, whatever its number of rows.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .select(*df.columns, name)
    )


def content_digest(df: DataFrame) -> Column:
    """MD5 of all values of a row as text; a null differs from an empty text."""
    texts = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in df.columns)
    return F.md5(F.concat_ws("\x1f", *texts))


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_sortable(f.dataType) for f in dtype)
    return _sortable(dtype.elementType) if isinstance(dtype, T.ArrayType) else not isinstance(dtype, T.MapType)


def with_content_index(df: DataFrame, name: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Positions 0..n-1 that follow what the rows hold and not how their files are split.

    Returns the table with positions, and its distinct rows, each with the lowest position
    of its copies. Rows are ordered by a digest of all their values, then by the values
    (nulls first); copies take consecutive positions. An empty table gives empty results.

    Copies are counted before the shuffle, so a row that makes up most of the table is one
    row of a task. The digest spreads the distinct rows over buckets of nearly equal size,
    which are ranked on their own and moved by the sizes of the buckets before them. Rows
    with many copies are written out in pieces by many tasks. As in any grouping, -0.0
    becomes 0.0.
    """
    clash = {name, *_OWN}.intersection(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    data = [F.col(f"`{c}`") for c in df.columns]
    copies = df.groupBy(*data).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_content", content_digest(df))
    copies = copies.withColumn("_bucket", F.substring("_content", 1, _BUCKET_DIGITS))
    ties = [F.col(f"`{f.name}`") for f in df.schema if _sortable(f.dataType)]
    inside = W.partitionBy("_bucket").orderBy("_content", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = materialize(copies.withColumn("_upto", F.sum("_copies").over(inside)), "contents")
    # At most 65,536 rows, whatever the size of the table.
    sizes = ranked.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(sizes.select("_bucket", before.alias("_before")), "offsets")
    first = (F.col("_before") + F.col("_upto") - F.col("_copies")).alias(name)
    distinct = ranked.join(F.broadcast(offsets), "_bucket").select(*data, first, "_copies", "_content")

    last = F.least(F.col("_copies"), (F.col("_piece") + 1) * COPIES_AT_ONCE) - 1
    positions = F.explode(F.sequence(F.col(name) + F.col("_piece") * COPIES_AT_ONCE, F.col(name) + last))
    few = distinct.where(F.col("_copies") <= COPIES_AT_ONCE).withColumn("_piece", F.lit(0).cast("long"))
    many = distinct.where(F.col("_copies") > COPIES_AT_ONCE)
    many = many.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES_AT_ONCE}"))))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = few.unionByName(many.repartition(tasks, "_content", "_piece"))
    return pieces.select(*data, positions.alias(name)), distinct.select(*data, name)


def rank_descending(df: DataFrame, group: str, row_id: str, name: str = "rank") -> DataFrame:
    """1-based rank of each row in its group, highest ``row_id`` first.

    ``row_id`` is a unique integer, so a chunk of its range holds at most ``CHUNK``
    rows of a group. Rows are ranked inside their chunk and shifted by the sizes of the
    chunks above: a group that holds most of the table still spreads over many tasks.
    """
    chunk = F.floor(F.col(row_id) / CHUNK)
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    above = W.partitionBy(group).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(group, "_chunk", F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_shift"))
    within = W.partitionBy(group, "_chunk").orderBy(F.desc(row_id))
    return (
        chunked.withColumn("_within", F.row_number().over(within))
        .join(shifts, [group, "_chunk"])
        .withColumn(name, F.col("_within") + F.col("_shift"))
        .drop("_chunk", "_within", "_shift")
    )
