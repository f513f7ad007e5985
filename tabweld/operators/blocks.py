"""Comparing all rows of two sides block by block, where no join leaves out enough.

The left side is cut into cells of like rows, and a right row goes to those that it can match in (``cells``).
A task holds a bounded number of rows of one cell and of the right rows that reach it. Inside it the left rows
are put in leaves of like numbers, or of like bigrams where there are none. A leaf meets only the right rows
that its bounds let reach the threshold; numpy compares these in tiles, so that a pair costs some matrix
elements and is written out only if it can reach it too.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.functions.similarity import PREFIX_LENGTH, PREFIX_WEIGHT, _jaro_winklers
from tabweld.operators.cells import Cells, bigrams, most_closeness, most_spelling, parting_sign, signs
from tabweld.operators.cells import closeness as _closeness
from tabweld.operators.scoring import EMBEDDING_WEIGHT, FIELD_WEIGHT, NUMBER_WEIGHT, TEXT_WEIGHT, RowScore

# The functions below travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT_ROWS = 16_384
LEAF_ROWS = 256
#: Lines of long texts have fewer rows: about so many characters.
_LINE_CHARS = 4_000_000
_TILE_CELLS = 500_000
_PART_CELLS = 2_000_000
_COUNT_CELLS = 8_000_000
_SLACK = 1e-6
_ROUGH = 4e-6  # what sums in single precision may lose
_SINGLE = 1e-30, 1e30  # magnitudes that single precision holds to seven digits
_FEW_ROWS = 512
_PICK = 50  # so few pairs have their cosines taken one by one
_MOST_GRAMS = 1 << 16
_FEW_CELLS = 6
_HELD_CHARS = 1_000_000  # texts that a task may hold of a side that goes to all tasks
_LETTERS = 64
_SUM_LOSS = 2e-7  # of a sum of single precision, for each of its terms


def in_blocks(left: DataFrame, right: DataFrame, compare: Callable, schema: T.StructType, rows: int) -> DataFrame:
    """Rows of ``compare(left table, right table)`` of every cell of lines of at most about ``rows`` rows."""

    def lines(n: int) -> int:
        return max(1, -(-n // rows), min(6, n // _FEW_ROWS))

    sides = (left, "left", lines(left.count())), (right, "right", lines(right.count()))
    on, tasks, placed = ["left_cell", "right_cell"], sides[0][2] * sides[1][2], []
    for (df, side, own), (_, other, more) in (sides, sides[::-1]):
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(more - 1).cast("bigint")))
        cells = df.withColumn(f"{side}_cell", F.pmod(F.xxhash64(f"{side}_id"), F.lit(own).cast("bigint"))).withColumn(f"{other}_cell", every)
        placed.append(cells.repartition(tasks, *on).groupBy(*on))
    return placed[0].cogroup(placed[1]).applyInArrow(lambda a, b: compare(a, b), schema)


def score_edges(row_score: RowScore, left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_id, right_id, score`` of all pairs of prepared sides that reach the threshold.

    For sides without identifiers and embedder. Dot products of bigram counts are sums of whole numbers,
    exact in single precision below 2^24, and the fields follow ``RowScore`` step by step: the scores are the same.
    """
    numbers, texts, least = row_score.indexes("number"), row_score.indexes("text"), row_score.threshold - _SLACK
    order = [(i, f.kind) for i, f in enumerate(row_score.fields)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("left_id", "right_id")] + [T.StructField(c, T.DoubleType()) for c in ("cosine", "field_score")])
    weight = NUMBER_WEIGHT * len(numbers) + TEXT_WEIGHT * len(texts)
    a_number, a_text = NUMBER_WEIGHT * FIELD_WEIGHT / weight, TEXT_WEIGHT * FIELD_WEIGHT / weight
    highest = row_score.most_cosine
    most_from_text = EMBEDDING_WEIGHT * highest
    lefts, rights = left.count(), right.count()
    length = max(1.0, _mean_length(left, "left"), _mean_length(right, "right"))
    rows = max(1, min(TEXT_ROWS, int(_LINE_CHARS / length)))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.table({"left_id": pa.array([], pa.int64()), "right_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "field_score": pa.array([], pa.float64())})]
        if a.num_rows and b.num_rows:
            x_row = a["left_text"].to_pylist()
            grams = _LeftGrams(x_row)
            # Without numbers, rows of a leaf share bigrams.
            leaves = _leaves([a[f"l{n}"].to_numpy().astype(float) for n in numbers], a.num_rows, LEAF_ROWS, None if numbers else signs(x_row))
            most = max(1, _COUNT_CELLS // grams.width)
            leaves = [leaf[k : k + most] for leaf in leaves for k in range(0, len(leaf), most)]
            for begin in range(0, b.num_rows, rows):
                out += part_edges(a, grams, leaves, most, b.slice(begin, rows))
        return pa.concat_tables(out)

    def part_edges(a: pa.Table, grams: _LeftGrams, leaves: list[np.ndarray], most: int, b: pa.Table) -> list[pa.Table]:
        out = []
        y_grams = _RightGrams(grams, b["right_text"].to_pylist())
        x_num, y_num = ({i: t[f"{s}{i}"].to_numpy().astype(float) for i in numbers} for t, s in ((a, "l"), (b, "r")))
        x_text, y_text = ({i: t[f"{s}{i}"].to_pylist() for i in texts} for t, s in ((a, "l"), (b, "r")))
        x_letters, y_letters = ({n: _letters(v) for n, v in side.items()} for side in (x_text, y_text))
        ids = a["left_id"].to_numpy(), b["right_id"].to_numpy()
        spelling = a_text * sum(_most_spelling(x_text[n], y_text[n]) if numbers else 1.0 for n in texts)
        tile = np.float32 if all(_holds_singly(v) for side in (x_num, y_num) for v in side.values()) else np.float64
        x_tile, y_tile = ({n: v.astype(tile) for n, v in side.items()} for side in (x_num, y_num))
        part, tops = max(1, _PART_CELLS // grams.width), None if numbers else grams.tops(leaves)
        for low in range(0, b.num_rows, most):
            right_rows = np.arange(low, min(low + most, b.num_rows))
            y, y_norm = y_grams.counts(low, right_rows[-1] + 1)
            exact = float(y_norm.max()) < 1 << 24
            y = y.astype(np.float32) if exact else y
            shares = None if numbers else (y.astype(np.float32, copy=False) @ tops.T) * ((1 + _SUM_LOSS * grams.width) / np.sqrt(y_norm))[:, None]
            for k, left_rows in enumerate(leaves):
                reach = most_from_text if shares is None else EMBEDDING_WEIGHT * np.minimum(shares[:, k] + _SLACK, highest)
                spelt = 0.0
                for n in texts:
                    lengths = x_letters[n][1][left_rows]
                    spelt = spelt + a_text * most_spelling(y_letters[n][1][right_rows], lengths[lengths > 0].min(initial=np.inf), lengths.max())
                spelt = np.minimum(spelt, spelling)
                reach = reach + spelt + FIELD_WEIGHT * NUMBER_WEIGHT * len(numbers) / weight
                for n in numbers:
                    reach = reach - a_number * (1 - _most_closeness(x_num[n][left_rows], y_num[n][right_rows]))
                meet = np.flatnonzero(~(np.broadcast_to(reach, len(right_rows)) < least))
                if not len(meet):
                    continue
                x, x_norm, held = grams.leaf(k, left_rows)
                narrow = 2 * len(held) < grams.width
                x_held = np.ascontiguousarray(x[:, held]) if narrow else x
                step = max(1, _TILE_CELLS // len(left_rows))
                for begin in range(0, len(meet), step):
                    met = meet[begin : begin + step]
                    best = _best([(x_tile[n][left_rows], y_tile[n][right_rows[met]]) for n in numbers], spelt[met] if texts else 0.0)
                    near = np.nonzero(~(best + most_from_text < least - _ROUGH)) if numbers else None
                    if near is not None and len(near[0]) * _PICK < best.size:
                        i, j = near
                        dots = np.concatenate([np.einsum("ij,ij->i", x[i[n : n + part]], y[met[j[n : n + part]]]) for n in range(0, len(i) or 1, part)])
                    else:
                        dots = x_held @ (y[np.ix_(met, held)] if narrow else y[met]).T
                        cosine = dots * (EMBEDDING_WEIGHT / np.sqrt(x_norm)).astype(dots.dtype)[:, None]
                        cosine *= (1 / np.sqrt(y_norm[met])).astype(dots.dtype)
                        cosine += best
                        i, j = np.nonzero(~(cosine < least - _ROUGH))
                        dots = dots[i, j]
                    cos = dots / np.sqrt(x_norm[i] * y_norm[met[j]])
                    i, j = left_rows[i], right_rows[met[j]]
                    reach = cos * EMBEDDING_WEIGHT
                    for n in numbers:
                        reach = reach + a_number * _closeness(x_num[n][i], y_num[n][j])
                    for n in texts:
                        reach = reach + a_text * _spelling_of_letters(x_letters[n], y_letters[n], i, j)
                    near = ~(reach < least)
                    i, j, cos = i[near], j[near], cos[near]
                    field = _fields(x_num, y_num, x_text, y_text, i, j)
                    near = ~(cos * EMBEDDING_WEIGHT + field * FIELD_WEIGHT < least)
                    if near.any():
                        out.append(pa.table({"left_id": ids[0][i[near]], "right_id": ids[1][j[near]], "cosine": cos[near], "field_score": field[near]}))
        return out

    def _best(columns: list[tuple[np.ndarray, np.ndarray]], spelling: np.ndarray | float) -> np.ndarray | float:
        """What the fields of each pair add to its score at most."""
        best = spelling
        for a, b in columns:
            apart = np.subtract.outer(a, b)
            np.abs(apart, out=apart)
            largest = np.maximum.outer(np.abs(a), np.abs(b))
            largest[largest == 0] = 1.0
            apart /= largest
            apart *= -a_number
            apart += a_number
            apart += best
            best = apart
        return best

    def _fields(x_num, y_num, x_text, y_text, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total, weights = np.zeros(len(i)), 0.0
        for n, kind in order:
            if kind == "number":
                total, weights = total + _closeness(x_num[n][i], y_num[n][j]) * NUMBER_WEIGHT, weights + NUMBER_WEIGHT
            else:
                spelling = _jaro_winklers([x_text[n][k] for k in i], [y_text[n][k] for k in j]) if len(i) else np.zeros(0)
                total, weights = total + spelling * TEXT_WEIGHT, weights + TEXT_WEIGHT
        return total / weights

    if lefts <= min(LEAF_ROWS, TEXT_ROWS) and lefts * length <= _HELD_CHARS:
        # So few rows go to every part of the other side.
        few = left.toArrow()

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from compare(few, pa.Table.from_batches([batch])).to_batches()

        pairs = right.mapInArrow(beside, schema)
    else:
        cells = max(1, -(-lefts // rows), min(_FEW_CELLS, lefts // _FEW_ROWS))
        found = Cells(left, lefts, rows, cells, length, numbers, texts, (a_number, a_text, EMBEDDING_WEIGHT), row_score.most_cosine, least - _SLACK)
        pairs = found.compared(right, rights, compare, schema)
    return row_score.mixed(pairs).filter(F.col("score") >= row_score.threshold).select("left_id", "right_id", "score")


def _mean_length(side: DataFrame, name: str) -> float:
    return side.agg(F.avg(F.length(f"{name}_text"))).first()[0] or 0.0


def _holds_singly(values: np.ndarray) -> bool:
    """Whether single precision holds each value to seven digits."""
    sizes = np.abs(values[values != 0])
    return bool(np.all((sizes > _SINGLE[0]) & (sizes < _SINGLE[1])))


class _LeftGrams:
    """The bigrams of the left texts of a task, which the right ones are counted by: others add to norms only."""

    def __init__(self, texts: list[str]):
        codes, text = bigrams(texts)
        self.kept, self.grams = np.unique(codes, return_inverse=True)
        self.width, self.rows = len(self.kept), len(texts)
        self.sizes = np.bincount(text, minlength=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.known, self.highest = {}, None

    def leaf(self, number: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of a leaf's texts, in single precision where that is exact, their norms, and the bigrams that they hold."""
        if number in self.known:
            return self.known[number]
        sizes = self.sizes[rows]
        upto = np.cumsum(sizes)
        place = np.arange(upto[-1]) + np.repeat(self.ends[rows] - upto, sizes)
        cells = np.repeat(np.arange(len(rows)) * self.width, sizes) + self.grams[place]
        x = np.bincount(cells, minlength=len(rows) * self.width).astype(float).reshape(len(rows), self.width)
        norm = np.einsum("ij,ij->i", x, x)
        found = x.astype(np.float32) if norm.max() < 1 << 24 else x, norm, np.flatnonzero(x.any(axis=0))
        if self.rows * self.width <= _COUNT_CELLS:
            self.known[number] = found
        return found

    def tops(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The most that a text of each leaf has of a bigram, over the text's norm."""
        if self.highest is None:
            self.highest = np.empty((len(leaves), self.width), dtype=np.float32)
            for k, leaf in enumerate(leaves):
                x, norm, _ = self.leaf(k, leaf)
                self.highest[k] = (x / np.sqrt(norm)[:, None]).max(axis=0)
        return self.highest


class _RightGrams:
    """The same bigrams in right texts, and the norms of all of theirs."""

    def __init__(self, left: _LeftGrams, texts: list[str]):
        codes, text = bigrams(texts)
        place = np.minimum(np.searchsorted(left.kept, codes), left.width - 1)
        shared = left.kept[place] == codes
        self.width, self.text, self.place = left.width, text[shared], place[shared]
        # A code has 42 bits: texts of a slice and codes fit in one number.
        cells, counts = np.unique((text[~shared] << 42) | codes[~shared], return_counts=True)
        self.rest = np.bincount(cells >> 42, weights=counts.astype(float) ** 2, minlength=len(texts))

    def counts(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.text, [low, high])
        cells = (self.text[a:b] - low) * self.width + self.place[a:b]
        y = np.bincount(cells, minlength=(high - low) * self.width).astype(float).reshape(high - low, self.width)
        return y, np.einsum("ij,ij->i", y, y) + self.rest[low:high]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each of some groups each text has, and its length."""
    known = [t or "" for t in texts]
    lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    chars = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    cells = np.repeat(np.arange(len(known)) * _LETTERS, lengths) + chars % _LETTERS
    return np.bincount(cells, minlength=len(known) * _LETTERS).astype(np.int32).reshape(len(known), _LETTERS), lengths.astype(float)


def _spelling_of_letters(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound on the Jaro-Winkler similarity of each pair of texts, from what characters they share in any order."""
    shared, part = np.empty(len(i)), _PART_CELLS // _LETTERS
    for k in range(0, len(i), part):
        shared[k : k + part] = np.minimum(a[0][i[k : k + part]], b[0][j[k : k + part]]).sum(axis=1)
    jaro = (shared / np.maximum(a[1][i], 1) + shared / np.maximum(b[1][j], 1) + 1) / 3
    return np.where(shared > 0, jaro + PREFIX_WEIGHT * PREFIX_LENGTH * (1 - jaro), 0.0)


def _leaves(columns: list[np.ndarray], rows: int, most: int, marks: np.ndarray | None = None) -> list[np.ndarray]:
    """The rows in halves of halves, by the column that is widest in each, down to ``most`` rows.

    With ``marks`` they are parted by the mark that tells most about the others.
    """
    done, open_ = [], [np.arange(rows)]
    while open_:
        leaf = open_.pop()
        if len(leaf) <= most:
            done.append(leaf)
            continue
        half, by = len(leaf) // 2, leaf
        if marks is not None:
            best = parting_sign(marks[leaf])
            if best is not None:
                has = marks[leaf, best]
                open_ += [leaf[~has], leaf[has]]
                continue
        elif columns:
            widths = [1 - _closeness(low, high) for low, high in ((v[leaf].min(), v[leaf].max()) for v in columns)]
            by = columns[int(np.argmax(widths))][leaf]
        split = np.argpartition(by, half)
        open_ += [leaf[split[:half]], leaf[split[half:]]]
    return done


def _most_closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How close each number of ``b`` is to any between the least and the most of ``a``, at most."""
    return most_closeness(a.min(), a.max(), b)


def _most_spelling(a: list[str], b: list[str]) -> float:
    """A bound on the Jaro-Winkler similarity of any two texts: matched characters are in both, each at most as often."""
    sides = []
    for texts in ([t for t in dict.fromkeys(a) if t], [t for t in dict.fromkeys(b) if t]):
        if not texts:
            return 0.0
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        cells, counts = np.unique((np.repeat(np.arange(len(texts)), lengths) << 21) | chars, return_counts=True)
        kept, place = np.unique(cells & ((1 << 21) - 1), return_inverse=True)
        tops = np.zeros(len(kept), dtype=np.int64)
        np.maximum.at(tops, place, counts)
        most = dict(zip(kept.tolist(), tops.tolist()))
        sides.append((most, int(lengths.min()), [{t[p] for t in texts if len(t) > p} for p in range(PREFIX_LENGTH)]))
    (x, x_least, x_starts), (y, y_least, y_starts) = sides
    shared = sum(min(n, y.get(c, 0)) for c, n in x.items())
    if not shared:
        return 0.0
    jaro = (min(1.0, shared / x_least) + min(1.0, shared / y_least) + 1) / 3
    prefix = 0
    while prefix < PREFIX_LENGTH and x_starts[prefix] & y_starts[prefix]:
        prefix += 1
    return jaro + PREFIX_WEIGHT * prefix * (1 - jaro)


def most_cosine(left: DataFrame, right: DataFrame) -> float:
    """A bound on the cosine of any two row texts: bigrams that one side lacks add to norms only."""
    from_side = {s: df.select(F.col(f"{s}_text").alias("t")) for s, df in (("left", left), ("right", right))}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.unique(_codes(batch.column(0).to_pylist())[0])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], ["gram"])

    sets = [from_side[s].mapInArrow(distinct, "gram long").distinct() for s in from_side]
    common = np.sort(np.array([r.gram for r in sets[0].intersect(sets[1]).limit(_MOST_GRAMS + 1).collect()], dtype=np.int64))
    if len(common) > _MOST_GRAMS:
        return 1.0

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, text = _codes(batch.column(0).to_pylist())
            if len(codes):
                grams, numbers = np.unique(codes, return_inverse=True)
                cells, counts = np.unique(text * len(grams) + numbers, return_counts=True)
                squares, known = counts.astype(float) ** 2, np.isin(grams, common)[cells % len(grams)]
                whole, shared = (np.bincount(cells // len(grams), weights=w) for w in (squares, squares * known))
                yield pa.RecordBatch.from_arrays([pa.array([float((shared / whole).max())])], ["share"])

    bound = 1.0
    for df in from_side.values():
        most = df.mapInArrow(shares, "share double").agg(F.max("share")).first()[0]
        bound *= float(np.sqrt(most or 0.0))
    return min(1.0, bound + _SLACK)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of padded texts as numbers, and the text that each is of."""
    return bigrams([t for t in texts if t is not None])
