"""Lossless join of dense vectors whose cosine reaches a bound, by metric partitioning.

Angles between vectors are a metric. A cosine of at least c is an angle of at most arccos(c).

* A bounded sample of the left vectors are pivots. Each left vector belongs to the region of its
  nearest pivot, and there to a ring of angles as wide as the bound.
* A right vector is listed in a region unless the triangle inequality excludes it: it must be within
  the bound of the region's ball, and not nearer to its own nearest pivot by over twice the bound.
  In a region it is listed in the rings that its angle less or plus the bound meets.

So every passing pair meets in exactly one cell, that of its left vector; cells with many rows are
divided by ``KeyJoin``. How much is excluded depends on the vectors: without clusters, or with a low
bound, most regions see most of the right side, and ``max_pairs`` turns that into an error.

``near_vectors`` therefore compares blocks of vectors by matrix products, which cost a pair a hundredth of
what a joined row costs; each task holds two blocks. Only pairs at the bound are written out and measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions.similarity import vector_cosine
from tabweld.operators.blocks import in_blocks
from tabweld.operators.candidates import KeyJoin, _check, _no_join
from tabweld.session import materialize

#: The sample's bound; the number of pivots grows with the root of the rows up to it.
MOST_PIVOTS = 1024
#: Cosines are computed in another order than the exact ones that decide.
SLACK = 1e-6
#: Vectors of a block, and pairs of a matrix product.
BLOCK_ROWS = 16_384
STRIP_PAIRS = 4_000_000


def _angles_to(pivots: np.ndarray):
    """Function from a list column to unit vectors' angles to all pivots, and which rows are not all zeros."""

    def angles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x = np.zeros((len(column), max(pivots.shape[1], int(sizes.max(initial=0)))))
        flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float))
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        known = norm > 0
        x[known] /= norm[known, None]
        return np.arccos(np.clip(x[:, : pivots.shape[1]] @ pivots.T, -1.0, 1.0)), known

    return angles


def metric_join(left: DataFrame, right: DataFrame, least_cosine: float, max_pairs: int | None = None) -> KeyJoin:
    """Pairs of ``left`` (``left_id``, ``left_vector``) and ``right`` (``right_id``, ``right_vector``) that can reach the cosine.

    Vectors of zeros, and null ones, have a cosine of 0 and are in no pair; ``least_cosine`` must be above 0.
    """
    if least_cosine <= SLACK:
        raise _no_join("a cosine of 0 or less bounds no pairs")
    bound = math.acos(min(1.0, least_cosine - SLACK)) + 1e-7
    known = left.where(F.exists("left_vector", lambda x: x != 0))
    count = known.count()
    most = min(MOST_PIVOTS, max(16, math.isqrt(count)))
    sample = known.select("left_vector").orderBy(F.xxhash64("left_vector"), "left_vector").limit(most).collect()
    width = max((len(r.left_vector) for r in sample), default=1)
    pivots = np.zeros((max(1, len(sample)), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r.left_vector)] = r.left_vector
        pivots[i] /= np.linalg.norm(pivots[i])
    angles = _angles_to(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, some = angles(batch.column("left_vector"))
            region, own = found.argmin(axis=1), found.min(axis=1)
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region, pa.int32()), pa.array((own / bound).astype(np.int32)), pa.array(own)], [*batch.schema.names, "region", "ring", "angle"]
            ).filter(keep)

    added = [T.StructField("region", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    placed = materialize(left.mapInArrow(place, T.StructType([*left.schema.fields, *added])), "placed-vectors")
    balls = placed.groupBy("region").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in balls:
        low[r.region], high[r.region] = r.low, r.high

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, some = angles(batch.column("right_vector"))
            near = some[:, None] & (found <= high + bound) & (found >= low - bound) & (found <= found.min(axis=1, keepdims=True) + 2 * bound)
            row, region = np.nonzero(near)
            at = found[row, region]
            first = (np.maximum(np.maximum(at - bound, low[region]), 0) / bound).astype(np.int32)
            last = (np.minimum(at + bound, high[region]) / bound).astype(np.int32)
            n = np.maximum(last - first + 1, 0)
            ring = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = batch.take(pa.array(np.repeat(row, n)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.repeat(region, n), pa.int32()), pa.array(ring, pa.int32())], [*rows.schema.names, "region", "ring"])

    listed = right.mapInArrow(reach, T.StructType([*right.schema.fields, *added[:2]]))
    cell = F.concat_ws(",", "region", "ring")
    a = placed.withColumn("key", cell).drop("region", "ring", "angle")
    join = KeyJoin(a, materialize(listed.withColumn("key", cell).drop("region", "ring"), "listed-vectors"))
    _check(join.pairs, max_pairs)
    return join


def near_vectors(left: DataFrame, right: DataFrame, least_cosine: float, max_pairs: int | None = None) -> DataFrame:
    """``left_id, right_id, cosine`` of all pairs of vectors with at least that cosine.

    ``max_pairs`` bounds the pairs that regions leave; without it blocks are compared.
    """
    pairs = _block_pairs(left, right, least_cosine) if max_pairs is None else metric_join(left, right, least_cosine, max_pairs).joined()
    return pairs.withColumn("cosine", vector_cosine(F.col("left_vector"), F.col("right_vector"))).where(F.col("cosine") >= least_cosine).select("left_id", "right_id", "cosine")


def _block_pairs(left: DataFrame, right: DataFrame, least_cosine: float) -> DataFrame:
    """Pairs that reach the cosine up to the slack, with their vectors."""
    if least_cosine <= SLACK:
        raise _no_join("a cosine of 0 or less bounds no pairs")
    least, strip = least_cosine - SLACK, STRIP_PAIRS

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks()
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x = np.zeros((len(column), int(sizes.max(initial=1))))
        flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float))
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.Table.from_arrays([*a.slice(0, 0).columns, *b.slice(0, 0).columns], names)]
        if a.num_rows and b.num_rows:
            x, y = unit(a["left_vector"]), unit(b["right_vector"])
            width, step = min(x.shape[1], y.shape[1]), max(1, strip // b.num_rows)
            for low in range(0, a.num_rows, step):
                i, j = np.nonzero(x[low : low + step, :width] @ y[:, :width].T >= least)
                found = [*a.take(pa.array(i + low)).columns, *b.take(pa.array(j)).columns]
                out.append(pa.Table.from_arrays(found, names))
        return pa.concat_tables(out)

    sides = [df.select(f"{s}_id", f"{s}_vector").where(F.exists(f"{s}_vector", lambda x: x != 0)) for s, df in (("left", left), ("right", right))]
    fields = [f for df in sides for f in df.schema.fields]
    names = [f.name for f in fields]
    return in_blocks(*sides, lambda a, b: compare(a.select(names[:2]), b.select(names[2:])), T.StructType(fields), BLOCK_ROWS)
