"""Cells of like rows, and the rows of the other side that can match a row of each at all.

A tree cuts the left rows into cells, by numbers or, where there are none, by bigrams that tell most about
the others. A sample places the cuts; the bounds of a cell are those of all its rows. A right row goes only to
the cells whose bounds let it reach the threshold, so what is shuffled grows with the rows and with how
many cells each can match in, not with the number of cells.
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

# The functions below travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sampled rows for a cell, and in all; they say where to cut.
CELL_SAMPLE = 128
MOST_SAMPLE = 65_536
_SAMPLE_CHARS = 8_000_000
#: Lines of right rows that one task takes, and how many tasks a small comparison is spread over.
RIGHT_LINES = 8
LEAST_TASKS = 36
SIGNS = 256
GRAMS = 1_024
_STEP_ROWS = 1_024
_PIECE_CHARS = 1_000_000
_BATCH_ROWS = 10_000
_HASHES = 1 << 30
_SIGN_ROWS = 512
_LEAST_SHARE = 0.05
_ROUND = 1e-4  # what sums of single precision may lose


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of texts with one space around them as numbers, and the text that each is of."""
    padded = [f" {t} " for t in texts]
    if not padded:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    starts = np.ones(len(chars), dtype=bool)
    starts[np.cumsum(lengths) - 1] = False
    first = np.flatnonzero(starts)
    return (chars[first] << 21) | chars[first + 1], np.repeat(np.arange(len(padded)), lengths - 1)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of a bounded number of characters, or of one text."""
    ends, begin = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))), 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, before + _PIECE_CHARS, side="right"))
        end = min(max(begin + 1, end), begin + _STEP_ROWS)
        yield begin, end
        begin = end


def signs(texts: list[str]) -> np.ndarray:
    """Which of some groups of bigrams each text holds."""
    out = np.zeros((len(texts), SIGNS), dtype=bool)
    for begin, end in _pieces(texts):
        codes, text = bigrams(texts[begin:end])
        out[text + begin, _bucket(codes, SIGNS)] = True
    return out


def gram_weights(texts: list[str]) -> np.ndarray:
    """Counts of groups of bigrams over the norm of the bigrams themselves.

    The dot product of two texts' rows is at least their cosine: to join coordinates adds products that are not negative.
    """
    out = np.zeros((len(texts), GRAMS), dtype=np.float32)
    for begin, end in _pieces(texts):
        codes, text = bigrams(texts[begin:end])
        kept, number = np.unique(codes, return_inverse=True)
        cells, counts = np.unique(text * len(kept) + number, return_counts=True)
        owner, buckets = cells // len(kept), _bucket(kept, GRAMS)[cells % len(kept)]
        norms = np.sqrt(np.bincount(owner, weights=counts.astype(float) ** 2, minlength=end - begin))
        flat = np.bincount(owner * GRAMS + buckets, weights=counts / norms[owner], minlength=(end - begin) * GRAMS)
        out[begin:end] = flat.reshape(end - begin, GRAMS)
    return out


def parting_sign(marks: np.ndarray) -> int | None:
    """The sign that tells most about the others: texts with and without it share the fewest bigrams. None if texts are alike."""
    few = marks[:: max(1, len(marks) // _SIGN_ROWS)].astype(np.float32)
    share = few.mean(axis=0)
    spread = share * (1 - share)
    parts = (share > _LEAST_SHARE) & (share < 1 - _LEAST_SHARE)
    if not parts.any():
        share = marks.mean(axis=0)
        parts = (share > 0) & (share < 1)
        return int(np.argmin(np.abs(share - 0.5))) if parts.any() else None
    together = few.T @ few / len(few) - np.outer(share, share)
    told = np.where(parts, (together**2).sum(axis=0) / np.where(parts, spread, 1), -1)
    return int(np.argmax(told))


def text_lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter((len(t) if t else 0 for t in texts), dtype=float, count=len(texts))


def most_spelling(lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bound on the Jaro-Winkler similarity of texts of these lengths and any of ``low`` to ``high`` characters."""
    other = np.clip(lengths, np.maximum(low, 1), np.maximum(high, 1))
    ratio = np.minimum(lengths, other) / np.maximum(lengths, other)
    # The prefix adds 0.4 of what the rest lacks at most.
    return np.where((lengths > 0) & (high > 0), 0.6 * (ratio + 2) / 3 + 0.4, 0.0)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    largest = np.maximum(np.abs(a), np.abs(b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(largest == 0, 1.0, 1.0 - np.abs(a - b) / largest)


def most_closeness(low: np.ndarray, high: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How close each number of ``b`` is to any between ``low`` and ``high``, at most."""
    # Numbers of unlike signs are never closer than 0, which two of them at the end of a range need not show.
    most = np.maximum(closeness(np.clip(b, low, high), b), 0.0)
    return np.where(np.isfinite(most) & np.isfinite(low) & np.isfinite(high), most, 1.0)


def _cut(columns: list[np.ndarray], marks: np.ndarray | None, rows: np.ndarray) -> tuple[int, float] | None:
    """Where to cut some rows: a column and its lowest value of the upper part, or -1 less a sign and 0; None if they are alike."""
    widths = [1 - closeness(low, high) for low, high in ((v[rows].min(), v[rows].max()) for v in columns)]
    for n in sorted(range(len(columns)), key=lambda n: -np.nan_to_num(widths[n])):
        values = columns[n][rows]
        at = np.partition(values, len(values) // 2)[len(values) // 2]
        upper = values[values > values.min()]
        if len(upper):
            return n, float(max(at, upper.min()))
    if marks is None:
        return None
    best = parting_sign(marks[rows])
    return None if best is None else (-1 - best, 0.0)


def _upper(cut: tuple[int, float], columns: list[np.ndarray], marks: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    at, value = cut
    return columns[at][rows] >= value if at >= 0 else marks[rows, -1 - at]


def tree_of(columns: list[np.ndarray], marks: np.ndarray | None, rows: int, most: int) -> list[tuple]:
    """Nodes ``(cut, lower node, upper node)`` or, at the end, ``(None, number of the cell)``."""
    nodes, open_, ends = [None], [(0, np.arange(rows))], 0
    while open_:
        at, inside = open_.pop()
        cut = _cut(columns, marks, inside) if len(inside) > most else None
        if cut is None:
            nodes[at], ends = (None, ends), ends + 1
            continue
        upper = _upper(cut, columns, marks, inside)
        nodes[at] = (cut, len(nodes), len(nodes) + 1)
        open_ += [(len(nodes), inside[~upper]), (len(nodes) + 1, inside[upper])]
        nodes += [None, None]
    return nodes


def place(nodes: list[tuple], columns: list[np.ndarray], marks: np.ndarray | None, rows: int) -> np.ndarray:
    """The cell of each row."""
    out, open_ = np.zeros(rows, dtype=np.int64), [(0, np.arange(rows))]
    while open_:
        at, inside = open_.pop()
        if not len(inside):
            continue
        if nodes[at][0] is None:
            out[inside] = nodes[at][1]
            continue
        cut, lower, higher = nodes[at]
        upper = _upper(cut, columns, marks, inside)
        open_ += [(lower, inside[~upper]), (higher, inside[upper])]
    return out


def _share(df: DataFrame, side: str, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the rows, told by a hash of their positions."""
    if rows <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64(f"{side}_id"), F.lit(_HASHES).cast("bigint")) < int(_HASHES * wanted / rows))


class Cells:
    """The cells of the left side: ``numbers`` and ``texts`` are the fields that rows are compared by.

    ``weights`` are what a number, a text and the cosine add to a score at most; ``most_cosine`` bounds the last.
    """

    def __init__(self, left: DataFrame, lefts: int, rows: int, cells: int, mean_length: float, numbers: list[int], texts: list[int], weights: tuple[float, float, float], most_cosine: float, least: float):
        self.left, self.numbers, self.texts = left, numbers, texts
        self.weights, self.most_cosine, self.least = weights, most_cosine, least
        self.rows = rows
        self.by_text = not numbers
        wanted = min(CELL_SAMPLE * cells, MOST_SAMPLE, int(_SAMPLE_CHARS / max(1.0, mean_length if self.by_text else 1.0)))
        few = _share(left, "left", lefts, wanted).select(*self._kept("left")).toArrow() if cells > 1 else None
        self.nodes = [(None, 0)]
        if few is not None and few.num_rows:
            # The order of collected rows is not fixed, and need not be: cuts depend on the values alone.
            columns, marks = self._features(few, "left")
            self.nodes = tree_of(columns, marks, few.num_rows, max(1, -(-few.num_rows // cells)))
        self._measure()

    def _kept(self, side: str) -> list[str]:
        return [f"{side[0]}{n}" for n in self.numbers] + ([f"{side}_text"] if self.by_text else [])

    def _features(self, batch, side: str) -> tuple[list[np.ndarray], np.ndarray | None]:
        columns = [batch[f"{side[0]}{n}"].to_numpy(zero_copy_only=False).astype(float) if isinstance(batch, pa.RecordBatch) else batch[f"{side[0]}{n}"].to_numpy().astype(float) for n in self.numbers]
        return columns, signs([t or "" for t in batch[f"{side}_text"].to_pylist()]) if self.by_text else None

    def _measured(self, batch: pa.RecordBatch, side: str) -> list[np.ndarray]:
        """The numbers of the rows and the lengths of their texts."""
        columns = [batch[f"{side[0]}{n}"].to_numpy(zero_copy_only=False).astype(float) for n in self.numbers]
        return columns + [text_lengths(batch[f"{side[0]}{n}"].to_pylist()) for n in self.texts]

    def _placer(self) -> Callable:
        nodes, features = self.nodes, self._plain()._features
        return lambda batch: place(nodes, *features(batch, "left"), batch.num_rows)

    def _plain(self) -> Cells:
        """What travels with the plan: no tables."""
        out = object.__new__(Cells)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "left"}
        return out

    def _measure(self) -> None:
        """The number of rows and the bounds of each cell, over all left rows."""
        of, own, width = self._placer(), self._plain(), len(self.numbers) + len(self.texts)
        types = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("top", pa.binary())])

        def batch_of(found: dict) -> pa.RecordBatch:
            cells = list(found)
            return pa.RecordBatch.from_pydict({"cell": cells, "n": [found[c][0] for c in cells], "low": [found[c][1].tolist() for c in cells], "high": [found[c][2].tolist() for c in cells], "top": [found[c][3].tobytes() for c in cells]}, schema=types)

        def add(found: dict, cell: int, n: int, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> None:
            if cell in found:
                m, a, b, c = found[cell]
                n, low, high, top = n + m, np.minimum(a, low), np.maximum(b, high), np.maximum(c, top)
            found[cell] = n, low, high, top

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for batch in batches:
                for begin in range(0, batch.num_rows, _BATCH_ROWS):
                    rows = batch.slice(begin, _BATCH_ROWS)
                    cells, values = of(rows), own._measured(rows, "left")
                    tops = gram_weights([t or "" for t in rows["left_text"].to_pylist()]) if own.by_text else np.zeros((rows.num_rows, 0), np.float32)
                    for cell in np.unique(cells).tolist():
                        at = np.flatnonzero(cells == cell)
                        add(found, cell, len(at), np.array([v[at].min() for v in values]), np.array([v[at].max() for v in values]), tops[at].max(axis=0))
            yield batch_of(found)

        def whole(key: tuple, group: pa.Table) -> pa.Table:
            found = {}
            for r in group.to_pylist():
                add(found, r["cell"], r["n"], np.array(r["low"]), np.array(r["high"]), np.frombuffer(r["top"], np.float32))
            return pa.Table.from_batches([batch_of(found)])

        schema = "cell long, n long, low array<double>, high array<double>, top binary"
        parts = self.left.mapInArrow(part, schema).groupBy("cell").applyInArrow(whole, schema).toArrow().to_pylist()
        count = sum(node[0] is None for node in self.nodes)
        self.sizes = np.zeros(count, np.int64)
        # A cell without rows is reached by none.
        self.low, self.high = np.full((count, width), np.nan), np.full((count, width), np.nan)
        self.tops = np.zeros((count, GRAMS if self.by_text else 0), np.float32)
        for r in parts:
            c = r["cell"]
            self.sizes[c], self.low[c], self.high[c], self.tops[c] = r["n"], r["low"], r["high"], np.frombuffer(r["top"], np.float32)

    def reached(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a cell that it can match in."""
        values = self._measured(batch, "right")
        number, text, cosine = self.weights
        full = self.sizes > 0
        rows, cells = [], []
        for begin in range(0, batch.num_rows, _STEP_ROWS):
            some = slice(begin, min(begin + _STEP_ROWS, batch.num_rows))
            m = some.stop - begin
            reach = np.full((m, len(full)), number * len(self.numbers) + text * len(self.texts) + cosine * self.most_cosine)
            if self.by_text:
                near = gram_weights([t or "" for t in batch["right_text"].slice(begin, m).to_pylist()]) @ self.tops.T
                reach -= cosine * (self.most_cosine - np.minimum(near * (1 + _ROUND) + _ROUND, self.most_cosine))
            reach[:, ~full] = -np.inf
            first = [(k, self._lost(k, values[k][some][:, None], self.low[:, k], self.high[:, k])) for k in range(min(2, len(values)))]
            for _, lost in first:
                reach -= lost
            i, j = np.nonzero(~(reach < self.least))
            reach = reach[i, j]
            for k in range(len(first), len(values)):
                reach = reach - self._lost(k, values[k][some][i], self.low[j, k], self.high[j, k])
                near = ~(reach < self.least)
                i, j, reach = i[near], j[near], reach[near]
            rows.append(i + begin)
            cells.append(j)
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64),) * 2

    def _lost(self, k: int, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """What field ``k`` of the measured ones takes from the score at least."""
        if k < len(self.numbers):
            return self.weights[0] * (1 - most_closeness(low, high, values))
        return self.weights[1] * (1 - most_spelling(values, low, high))

    def compared(self, right: DataFrame, rights: int, compare: Callable, schema: T.StructType) -> DataFrame:
        """Rows of ``compare(left table, right table)`` of every cell, a bounded number of rows of each side at a time."""
        own, of, most = self._plain(), self._placer(), self.rows
        wanted = min(rights, MOST_SAMPLE)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(own.sizes), np.int64)
            for batch in batches:
                total += np.bincount(own.reached(batch)[1], minlength=len(total))
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": kept, "n": total[kept]}, schema=pa.schema([("cell", pa.int64()), ("n", pa.int64())]))

        found = _share(right, "right", rights, wanted).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
        met = np.zeros(len(self.sizes))
        for cell, n in found:
            met[cell] = n * rights / wanted
        spread = -(-LEAST_TASKS // max(1, len(found)))
        left_lines = np.maximum(1, -(-self.sizes // most))
        right_lines = np.maximum(1, np.maximum(np.ceil(met / (RIGHT_LINES * most)), np.minimum(spread, met // (most / 32)))).astype(np.int64)
        blocks = left_lines * right_lines
        start = np.cumsum(blocks) - blocks
        tasks = int(blocks[(self.sizes > 0)].sum())

        def out(batch: pa.RecordBatch, rows: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            for begin in range(0, len(rows), _BATCH_ROWS):
                taken = batch.take(pa.array(rows[begin : begin + _BATCH_ROWS]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block[begin : begin + _BATCH_ROWS])], names=[*taken.schema.names, "block"])

        def dealt(side: str, cells_of: Callable, own_lines: np.ndarray, other_lines: np.ndarray, own_step: Callable, other_step: Callable) -> Callable:
            """Each row under a line of its side and all lines of the other one."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows, cells = cells_of(batch)
                    hashes = batch["line"].to_numpy(zero_copy_only=False)[rows]
                    line, copies = hashes % own_lines[cells], other_lines[cells]
                    other = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                    rows, cells, line = (np.repeat(x, copies) for x in (rows, cells, line))
                    yield from out(batch.drop_columns(["line"]), rows, start[cells] + line * own_step(cells) + other * other_step(cells))

            return run

        one = lambda cells: np.ones(len(cells), np.int64)
        lines = lambda cells: right_lines[cells]
        runs = {
            "left": dealt("left", lambda batch: (np.arange(batch.num_rows), of(batch)), left_lines, right_lines, lines, one),
            "right": dealt("right", own.reached, right_lines, left_lines, one, lines),
        }
        placed = []
        for side, df in (("left", self.left), ("right", right)):
            hashed = df.withColumn("line", F.pmod(F.xxhash64(f"{side}_id", F.lit(1)), F.lit(_HASHES).cast("bigint")))
            fields = T.StructType([*df.schema.fields, T.StructField("block", T.LongType())])
            placed.append(hashed.mapInArrow(runs[side], fields).repartition(max(1, tasks), "block").groupBy("block"))
        return placed[0].cogroup(placed[1]).applyInArrow(lambda a, b: compare(a.drop_columns(["block"]), b.drop_columns(["block"])), schema)
