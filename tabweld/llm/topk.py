"""Exact top-k search by inner product with M-trees: paged metric nodes, searched best first.

Inner products become distances: with ``M`` the largest squared length, a vector ``x`` gets one
more component ``sqrt(M - x.x)`` and a query ``q`` a zero, so that ``d(q, x)^2 = q.q + M - 2 q.x``
and the largest products are the smallest distances.

1. Equal vectors are one entry with the ``k + 1`` smallest of their ids: no list needs more of them.
2. A bounded sample of vectors divides the rest into regions by the nearest one (their number grows with
   the root of the rows); regions are cut by a hash into trees of at most about ``TREE_ROWS`` entries. Each tree is built once into pages of
   up to ``PAGE_ROWS`` entries, written as a table: an entry has its routing vector, its covering
   radius and its distance to the entry above it.
3. Every query first searches the tree it lies in, which gives a score that its last result will
   have at least. Then it goes to the regions whose covering radius that score does not exclude.
4. In a tree pages are taken in the order of their lower bounds. An entry whose stored parent
   distance already excludes it by the triangle inequality is not computed at all; the rest of a
   page is computed in one product. Scores are whole numbers and exact.

Queries of the same regions travel in blocks of about ``BLOCK_ROWS``; pages go to the blocks that reach
their tree. A task holds the pages of one tree and one block.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweld.llm.common import ship_by_value
from tabweld.session import materialize

REGIONS, MOST_REGIONS = 32, 4096
TREE_ROWS = 8192
PAGE_ROWS = 128
BLOCK_ROWS = 2048

PAGES = "region int, part int, page int, leaf boolean, vectors binary, lift binary, above binary, radius binary, child binary, ids binary"

ship_by_value(__name__)


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", factor: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``, the components times ``factor`` rounded down.

    Rows without an id or vector and vectors with null or non-finite components take no part.
    """
    x = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & finite).select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * factor).cast("long")).alias("v")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; short ones end in zeros, which add nothing to a product."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rows_of(values: pd.Series, width: int) -> np.ndarray:
    return matrix(pa.array(values, pa.list_(pa.int64())), width)


def lifts(x: np.ndarray, largest: float) -> np.ndarray:
    """The added component of data vectors."""
    squares = np.einsum("ij,ij->i", x.astype(float), x.astype(float))
    return np.sqrt(np.maximum(largest - squares, 0.0))


def distances(x: np.ndarray, x_lift: np.ndarray, y: np.ndarray, y_lift: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all rows of ``y``."""
    a, b = x.astype(float), y.astype(float)
    squares = (np.einsum("ij,ij->i", a, a) + x_lift**2)[:, None] + (np.einsum("ij,ij->i", b, b) + y_lift**2)[None, :]
    return np.sqrt(np.maximum(squares - 2 * (a @ b.T + np.outer(x_lift, y_lift)), 0.0))


def build_pages(x: np.ndarray, lift: np.ndarray, root: np.ndarray, root_lift: float, page_rows: int = PAGE_ROWS) -> list[tuple]:
    """Pages (leaf, rows, above, radius, child) of a tree under one routing vector; page 0 is the root's.

    An inner page picks up to ``page_rows`` of its vectors as routing vectors, evenly, and gives
    every vector to the nearest; if that does not divide them, they are cut into runs.
    """
    pages: list[tuple | None] = []

    def build(own: np.ndarray, centre: np.ndarray, centre_lift: float) -> int:
        number = len(pages)
        pages.append(None)
        above = distances(x[own], lift[own], centre[None, :], np.array([centre_lift]))[:, 0]
        if len(own) <= page_rows:
            pages[number] = (True, own, above, np.zeros(len(own)), np.zeros(len(own), np.int32))
            return number
        fan = min(page_rows, -(-len(own) // (page_rows // 2)) + 1)
        picked = own[np.linspace(0, len(own) - 1, fan).astype(int)]
        to_picked = distances(x[own], lift[own], x[picked], lift[picked])
        nearest = to_picked.argmin(axis=1)
        if np.bincount(nearest).max() == len(own):
            nearest = np.arange(len(own)) * fan // len(own)
        used = np.unique(nearest)
        radius = np.array([to_picked[nearest == j, j].max() for j in used])
        child = np.array([build(own[nearest == j], x[picked[j]], lift[picked[j]]) for j in used], np.int32)
        routing = picked[used]
        above = distances(x[routing], lift[routing], centre[None, :], np.array([centre_lift]))[:, 0]
        pages[number] = (False, routing, above, radius, child)
        return number

    build(np.arange(len(x)), root, root_lift)
    return pages


class Page:
    """A page read back from the table."""

    def __init__(self, row, width: int):
        self.leaf = row.leaf
        self.vectors = np.frombuffer(row.vectors, np.int64).reshape(-1, width)
        self.floats = self.vectors.astype(float)
        self.lift = np.frombuffer(row.lift, float)
        self.squares = np.einsum("ij,ij->i", self.floats, self.floats) + self.lift**2
        self.above = np.frombuffer(row.above, float)
        self.radius = np.frombuffer(row.radius, float)
        self.child = np.frombuffer(row.child, np.int32)
        self.ids = np.frombuffer(row.ids, np.int64).reshape(len(self.vectors), -1) if row.leaf else None


def best_first(pages: dict[int, Page], query: np.ndarray, root_distance: float, largest: float, least: int | None, k: int) -> tuple[list[tuple[int, int]], int]:
    """The ``k`` best ids (by their best score, smaller id first) of a tree that score at least ``least``,
    and the number of distances computed. ``EMPTY`` fills the lists of ids."""
    q, square = query.astype(float), float(query.astype(float) @ query.astype(float))
    slack = 1e-7 * (1.0 + math.sqrt(square + largest))
    kept: list[tuple[int, int]] = []  # worst first: (score, -id), each id once
    best: dict[int, int] = {}

    def limit() -> float:
        floor = kept[0][0] if len(kept) == k else None
        if least is not None and (floor is None or least > floor):
            floor = least
        return math.inf if floor is None else math.sqrt(max(square + largest - 2.0 * floor, 0.0)) + slack

    queue, bound, computed = [(0.0, 0, root_distance)], limit(), 0
    while queue:
        low, number, above = heapq.heappop(queue)
        if low > bound:
            break
        page = pages[number]
        near = np.flatnonzero(np.abs(above - page.above) - page.radius <= bound)
        computed += len(near)
        if not len(near):
            continue
        if page.leaf:
            scores = page.vectors[near] @ query
            floor = kept[0][0] if len(kept) == k else least
            if floor is not None:
                good = scores >= floor
                near, scores = near[good], scores[good]
            for at in np.argsort(-scores, kind="stable"):
                score = int(scores[at])
                if len(kept) == k and score < kept[0][0]:
                    break
                for own in page.ids[near[at]].tolist():
                    if own == EMPTY:
                        break
                    entry = (score, -own)
                    if len(kept) == k and entry <= kept[0]:
                        break  # so are the entry's other ids, which are larger
                    known = best.get(own)
                    if known is not None and known >= score:
                        continue
                    if known is not None:
                        kept.remove((known, -own))
                    elif len(kept) == k:
                        del best[-kept.pop(0)[1]]
                    insort(kept, entry)
                    best[own] = score
            bound = limit()
        else:
            d = np.sqrt(np.maximum(square + page.squares[near] - 2.0 * (page.floats[near] @ q), 0.0))
            for j, x in zip(near.tolist(), d.tolist()):
                low = max(x - page.radius[j], 0.0)
                if low <= bound:
                    heapq.heappush(queue, (low, int(page.child[j]), x))
    return sorted(((s, -i) for s, i in kept), key=lambda e: (-e[0], e[1])), computed


#: Fills an entry's list of ids; no row can have it and be found by its vector alone.
EMPTY = -(1 << 63)


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products for every query row.

    ``rows`` has ``vec_id`` and ``v`` (whole numbers); ``is_query`` is a condition on ``vec_id``.
    Candidates are all ids but the query's own; ties go to the smaller id. An id with several vectors is
    one candidate, or one query, by the best of its products. Repeated rows count once. Vectors of different lengths are multiplied as far as both go. Products must
    stay below 2^63. Empty tables give an empty result.
    """
    rows = materialize(rows.distinct(), "vectors")
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(squared("v")).alias("largest")).first()
    spark = rows.sparkSession
    if shape.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(shape.width, 1), shape.largest
    wanted = k + 1  # the query's own id is left out at the end
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= wanted)
    entries = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = rows.where(is_query)
    queries = asked.select("v").distinct()

    most = min(MOST_REGIONS, max(REGIONS, math.isqrt(entries.count()) // 8))
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(most).select("v").collect()
    centres = np.zeros((len(sample), width), np.int64)
    for i, r in enumerate(sample):
        centres[i, : len(r.v)] = r.v
    centre_lift = lifts(centres, largest)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)
            d = distances(x, lifts(x, largest), centres, centre_lift)
            region = d.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(d.min(axis=1))], [*batch.schema.names, "region", "far"])

    placed = materialize(entries.mapInArrow(nearest, "v array<long>, ids array<long>, region int, far double"), "placed-entries")
    regions = placed.groupBy("region").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    parts, radius = [1] * len(centres), np.full(len(centres), -1.0)
    for r in regions:
        parts[r.region], radius[r.region] = max(1, math.ceil(r.n / TREE_ROWS)), r.radius

    def pages_of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = rows_of(group["v"], width)
        lift = lifts(x, largest)
        ids = np.full((len(x), wanted), EMPTY, np.int64)
        for i, own in enumerate(group["ids"]):
            ids[i, : len(own)] = own
        region, part = key
        out = []
        for number, (leaf, own, above, cover, child) in enumerate(build_pages(x, lift, centres[region], centre_lift[region])):
            out.append((region, part, number, leaf, x[own].tobytes(), lift[own].tobytes(), above.tobytes(), cover.tobytes(), child.tobytes(), ids[own].tobytes() if leaf else b""))
        return pd.DataFrame(out, columns=[f.split()[0] for f in PAGES.split(", ")])

    part = part_of(parts)
    pages = materialize(placed.withColumn("part", part).groupBy("region", "part").applyInPandas(pages_of, PAGES), "pages")

    home = materialize(queries.join(placed.select("v", "region"), "v").withColumn("part", part), "queries")
    asking = {r.region: r["count"] for r in home.groupBy("region").count().collect()}
    base, splits, before = [], [], 0
    for region in range(len(centres)):  # regions with few queries share a block
        own = asking.get(region, 0)
        base.append(before // BLOCK_ROWS)
        splits.append(max(1, own // BLOCK_ROWS))
        before += own
    own_base, own_splits = (F.get(F.array(*map(F.lit, x)), F.col("region")) for x in (base, splits))
    block = (own_base + F.pmod(F.xxhash64("v", F.lit(7)), own_splits)).cast("long")
    home = home.withColumn("block", block)

    def search(key: tuple, page_rows: pd.DataFrame, asked_rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(page_rows) and len(asked_rows):
            tree = {row.page: Page(row, width) for row in page_rows.itertuples()}
            qs = rows_of(asked_rows["v"], width)
            start = distances(qs, np.zeros(len(qs)), centres[key[0]][None, :], centre_lift[key[0]][None])[:, 0]
            for i, (v, least) in enumerate(zip(asked_rows["v"], asked_rows["least"])):
                least = None if pd.isna(least) else int(least)
                best, _ = best_first(tree, qs[i], start[i], largest, least, wanted)
                found.extend((v, score, vec_id) for score, vec_id in best)
        return pd.DataFrame(found, columns=["v", "score", "vec_id"])

    def searched(pairs: DataFrame) -> DataFrame:
        keys = ["region", "part", "block"]
        spread = pages.join(materialize(pairs.select(*keys).distinct(), "reached-trees"), ["region", "part"])
        return pairs.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(
            lambda key, asked_rows, page_rows: search(key, page_rows, asked_rows), "v array<long>, score long, vec_id long"
        )

    home = home.withColumn("least", F.lit(None).cast("string"))
    first = materialize(searched(home), "home-results")
    order = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    seen = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == wanted)
    bounds = home.select("v", "block", F.col("region").alias("home"), F.col("part").alias("home_part"))
    bounds = bounds.join(seen.select("v", F.col("score").alias("least")), "v", "left")

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(0), width)
            d = distances(q, np.zeros(len(q)), centres, centre_lift)
            square = np.einsum("ij,ij->i", q.astype(float), q.astype(float))
            least = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            limit = np.sqrt(np.maximum(square + largest - 2.0 * least, 0.0)) + 1e-7 * (1.0 + np.sqrt(square + largest))
            ok = ~(d - radius[None, :] > limit[:, None]) & (radius >= 0)[None, :]  # without a bound nothing is excluded
            i, region = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(region.astype(np.int32))], [*batch.schema.names, "region"])

    pairs = bounds.mapInArrow(reachable, "v array<long>, block long, home int, home_part int, least long, region int")
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.array(*map(F.lit, parts)), F.col("region")) - 1)))
    pairs = pairs.where((F.col("region") != F.col("home")) | (F.col("part") != F.col("home_part")))
    pairs = materialize(pairs.select("v", "region", "part", "block", F.col("least").cast("string").alias("least")), "query-trees")
    each = first.unionByName(searched(pairs)).groupBy("v", "vec_id").agg(F.max("score").alias("score"))
    best = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted)
    lists = asked.select(F.col("vec_id").alias("query_id"), "v").join(best.select("v", "score", "vec_id"), "v")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = lists.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return lists.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def squared(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def part_of(parts: list[int]) -> Column:
    """The tree of a region that a vector belongs to."""
    return F.pmod(F.xxhash64("v", F.lit(3)), F.get(F.array(*map(F.lit, parts)), F.col("region"))).cast("int")
