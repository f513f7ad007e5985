"""Which pairs of rows are compared.

Every way here is lossless: it is derived from the threshold, the weights and the fact
that a cosine and each field similarity are at most 1. Pairs left out cannot pass.

* Enough identifiers must be equal: an equi-join on that many identifier columns.
* Each pair of numbers must lie within a known ratio: an equi-join on logarithmic bands
  of numeric columns.
* The row texts must have a cosine of at least ``(threshold - 0.7) / 0.3``: an equi-join
  on each text's rarest bigrams, as many as leave too little for that cosine.
* So must an embedder's vectors: an equi-join on regions of vectors (``metric_join``).

Of the last three the one with the fewest pairs to compare is taken. Where none holds (a
threshold of 0.7 or less without numbers that bound the pairs) no equi-join keeps every passing pair, and ``NoLosslessJoin`` is raised rather than
comparing all rows with all rows.

Comparing a pair costs far more than shuffling a row, so the joins are divided by the
number of pairs, which is counted first, and not by bytes: a key with many rows becomes
a grid of cells, and the cells are spread over as many tasks as the pairs ask for.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabweld.operators.scoring import EMBEDDING_WEIGHT, FIELD_WEIGHT, NUMBER_WEIGHT, RowScore
from tabweld.session import materialize

CELL_ROWS = 2_000
PAIRS_PER_TASK = 500_000
BAND_COLUMNS = 2
_EDGE = 1e-9
_FINEST_RATIO = 0.99
_BAND_SHIFT = 1 << 40  # keeps every band of a nonzero number away from 0
_COSINE_SLACK = 1e-6
_FEW_PAIRS = 1_000_000  # so few are compared sooner than another way is counted


class NoLosslessJoin(ValueError):
    """The columns and the threshold leave no exact way but comparing all pairs."""


def _no_join(reason: str) -> NoLosslessJoin:
    return NoLosslessJoin(
        f"{reason}; raise the threshold, name identifier columns with id_columns=, or match more columns"
    )


def keyed(df: DataFrame, side: str, ids: tuple[int, ...]) -> DataFrame:
    """Rows that have all the identifiers, with one key for them; lengths keep parts apart."""
    texts = [F.col(f"{side[0]}{i}") for i in ids]
    parts = [part for t in texts for part in (F.length(t).cast("string"), F.lit(":"), t)]
    key = texts[0] if len(texts) == 1 else F.concat(*parts)
    return df.withColumn("key", key).filter(F.col("key").isNotNull())


def key_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``key, lefts, rights``: rows per key on each side, from one shuffle of counts."""
    both = left.select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("key", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return both.groupBy("key").agg(F.sum("l").alias("lefts"), F.sum("r").alias("rights"))


def tasks_for(pairs: int) -> int:
    """How many tasks share the comparison of that many pairs."""
    return max(1, math.ceil(pairs / PAIRS_PER_TASK))


class KeyJoin:
    """The equi-join of two sides on ``key``, with the number of its pairs known beforehand."""

    def __init__(self, left: DataFrame, right: DataFrame):
        self.left, self.right = left, right
        self.counts = materialize(key_counts(left, right), "key-counts")
        pairs, self.widest = self.counts.agg(
            F.sum(F.col("lefts").cast("decimal(38,0)") * F.col("rights")), F.max(F.greatest("lefts", "rights"))
        ).first()
        self.pairs = int(pairs or 0)

    def joined(self) -> DataFrame:
        """The pairs, spread evenly whatever the number of rows per key.

        A key of l and r rows is a grid of cells of about ``CELL_ROWS`` rows a side; each
        row goes to one line of cells. The cell of a row depends on its position alone,
        so a repeated task sends it to the same cell. Rows of a key that the other side
        lacks are dropped before they are spread.
        """
        left, right, on = self.left, self.right, ["key"]
        if (self.widest or 0) > CELL_ROWS:
            shared = self.counts.filter((F.col("lefts") > 0) & (F.col("rights") > 0))
            lines = [F.ceil(F.col(c) / CELL_ROWS).alias(n) for c, n in (("lefts", "left_lines"), ("rights", "right_lines"))]
            grid = shared.select("key", *lines)
            on = ["key", "left_cell", "right_cell"]
            left, right = self._cells(left, grid, "left", "right"), self._cells(right, grid, "right", "left")
        tasks = tasks_for(self.pairs)
        # Sizes of replicated rows are not known to the planner: no broadcast here.
        return left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on).drop(*on)

    @staticmethod
    def _cells(rows: DataFrame, grid: DataFrame, side: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(f"{side}_id"), F.col(f"{side}_lines"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_lines") - 1))
        placed = rows.join(grid, "key").withColumn(f"{side}_cell", own).withColumn(f"{other}_cell", every)
        return placed.drop("left_lines", "right_lines")


def _check(pairs: int, max_pairs: int | None) -> None:
    if max_pairs is not None and pairs > max_pairs:
        raise _no_join(f"{pairs} pairs to compare exceed max_pairs={max_pairs}")


def id_subset_pairs(row_score: RowScore, left: DataFrame, right: DataFrame, needed: int, max_pairs: int | None = None) -> DataFrame:
    """Pairs equal on at least ``needed`` identifiers: one equi-join per subset.

    A pair is kept under the first subset it is equal on, which the pair itself shows,
    so no shuffle is needed to tell repeats apart.
    """
    ids = tuple(row_score.indexes("id"))
    branches, total = [], 0
    for subset in combinations(ids, needed):
        a, b = keyed(left, "left", subset), keyed(right, "right", subset)
        join = KeyJoin(a, b)
        if needed < len(ids):
            total += join.pairs
            _check(total, max_pairs)
        pairs = join.joined()
        # Another equal identifier ahead of the subset's last one means an earlier subset.
        for i in set(ids[: ids.index(subset[-1])]) - set(subset):
            same = F.coalesce(F.col(f"l{i}") == F.col(f"r{i}"), F.lit(False))
            pairs = pairs.filter(~same)
        branches.append(pairs)
    pairs = branches[0]
    for more in branches[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _band(value: Column, ratio: float) -> Column:
    """Logarithmic band of a magnitude, its sign kept apart; 0 has a band of its own."""
    value = value.cast("double")
    exponent = F.floor(F.log(F.abs(value)) / F.lit(-math.log(ratio)))
    return F.when(value == 0, F.lit(0)).otherwise(exponent * 2 + F.when(value > 0, F.lit(0)).otherwise(1) + _BAND_SHIFT)


def _sharpest(left: DataFrame, numbers: list[int], ratio: float) -> list[int]:
    """The columns with the most bands: each one listed triples the rows of the right side."""
    if len(numbers) <= BAND_COLUMNS:
        return numbers
    counts = left.agg(*[F.approx_count_distinct(_band(F.col(f"l{i}"), ratio)) for i in numbers]).first()
    order = sorted(range(len(numbers)), key=lambda n: -counts[n])
    return [numbers[n] for n in order[:BAND_COLUMNS]]


def _band_join(row_score: RowScore, left: DataFrame, right: DataFrame, ids_known: bool) -> KeyJoin | None:
    """Pairs whose numbers all lie within the ratio that the threshold demands.

    If a pair passes, each number field loses at most ``(1 - least) * total weight``, so
    its closeness is at least ``ratio``; closeness is the ratio of the magnitudes for
    equal signs and at most 0 for unequal ones. Magnitudes within that ratio lie in the
    same or neighbouring logarithmic bands, so the right side is listed under all three.
    Numbers must not be null (prepared sides are imputed); ``ids_known=False`` says that
    no pair has an identifier on both sides, which makes the bound tighter.
    """
    numbers = row_score.indexes("number")
    loss = (1 - row_score.least_field_score) * row_score.weight(
        ("id", "number", "text") if ids_known else ("number", "text")
    )
    ratio = min(1 - loss / NUMBER_WEIGHT - _EDGE, _FINEST_RATIO)
    if not numbers or ratio <= 0.01:
        return None
    bands = []
    for i in _sharpest(left, numbers, ratio):
        left = left.withColumn(f"band{i}", _band(F.col(f"l{i}"), ratio))
        band = _band(F.col(f"r{i}"), ratio)
        near = F.when(band == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(band - 2, band, band + 2))
        right = right.withColumn(f"band{i}", F.explode(near))
        bands.append(f"band{i}")
    key = F.concat_ws(",", *bands)
    return KeyJoin(left.withColumn("key", key).drop(*bands), right.withColumn("key", key).drop(*bands))


def _gram_counts(rows: DataFrame, side: str) -> DataFrame:
    """``id, gram, n``: the bigrams of each row text with one space around it."""
    padded = F.concat(F.lit(" "), F.col(f"{side}_text"), F.lit(" "))
    places = F.sequence(F.lit(1), F.length(f"{side}_text") + 1)
    grams = F.transform(places, lambda i: F.substr(padded, i, F.lit(2)))
    return rows.select(F.col(f"{side}_id").alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def _gram_join(row_score: RowScore, left: DataFrame, right: DataFrame) -> KeyJoin | None:
    """Pairs that share one of both texts' leading bigrams, in the order of their rarity.

    Let a text's bigrams from g on (g included) have a norm below ``least`` times the whole:
    if g is the rarest bigram that two texts share, their cosine is below ``least``. So a
    text needs only the bigrams before that point, and a passing pair shares one of these.
    A pair that shares several is kept under the rarest, which both lists show.
    """
    least = (row_score.threshold - FIELD_WEIGHT) / EMBEDDING_WEIGHT - _COSINE_SLACK
    if row_score.embed or least <= 0:
        return None
    counts = {s: materialize(_gram_counts(rows, s), "bigrams") for s, rows in (("left", left), ("right", right))}
    rarity = counts["left"].unionByName(counts["right"]).groupBy("gram").agg(F.count("*").alias("texts"))
    rarity = materialize(rarity, "bigram-texts")

    def leading(rows: DataFrame, side: str) -> DataFrame:
        own = W.partitionBy("id")
        rest = F.sum(F.col("n") * F.col("n")).over(own.orderBy("texts", "gram").rowsBetween(W.currentRow, W.unboundedFollowing))
        whole = F.sum(F.col("n") * F.col("n")).over(own)
        kept = counts[side].join(rarity, "gram").withColumns({"rest": rest, "whole": whole})
        kept = kept.where(F.col("rest") >= F.col("whole") * least * least)
        listed = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("texts", "gram"))).alias("g"))
        listed = listed.select(F.col("id").alias(f"{side}_id"), F.col("g.gram").alias(f"{side}_grams"))
        return rows.join(listed, f"{side}_id").withColumn("key", F.explode(f"{side}_grams"))

    return KeyJoin(leading(left, "left").withColumn("gram", F.col("key")), leading(right, "right"))


def _vector_join(row_score: RowScore, left: DataFrame, right: DataFrame) -> KeyJoin | None:
    """Pairs whose embedders' vectors can have the cosine that the threshold demands."""
    from tabweld.operators.metric_join import metric_join  # which needs KeyJoin

    least = (row_score.threshold - FIELD_WEIGHT) / EMBEDDING_WEIGHT - _COSINE_SLACK
    return metric_join(left, right, least) if row_score.embed and least > _COSINE_SLACK else None


def value_pairs(
    row_score: RowScore, left: DataFrame, right: DataFrame, max_pairs: int | None = None, ids_known: bool = True
) -> DataFrame:
    """Pairs that can pass without an equal identifier, by numbers or by texts.

    ``max_pairs`` turns a larger comparison into an error; there is no limit by default.
    """
    band = _band_join(row_score, left, right, ids_known)
    enough = band is not None and band.pairs <= _FEW_PAIRS
    gram = None if enough else _gram_join(row_score, left, right)
    ways = [way for way in (band, gram, None if enough else _vector_join(row_score, left, right)) if way]
    if not ways:
        raise _no_join("no identifier, number or text bounds the pairs at this threshold")
    way = min(ways, key=lambda w: w.pairs)
    _check(way.pairs, max_pairs)
    if way is not gram:
        return way.joined()
    first = F.get(F.array_intersect("left_grams", "right_grams"), F.lit(0))
    return way.joined().where(first == F.col("gram")).drop("gram", "left_grams", "right_grams")
