"""The greedy pass inside groups of rows whose identifiers are equal, each in one task.

All passing pairs of a group score 1, so the pass takes, for the highest left row, the highest free
right row that passes, and so on down. Left rows are compared with the highest free right rows first,
and only those that found no partner there with the next ones: that a row's partner lies further
down changes nothing for the rows above it. So most rows are compared with few others.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tabweld.functions.similarity import _Grams, _jaro_winklers
from tabweld.operators.scoring import EMBEDDING_WEIGHT, FIELD_WEIGHT, SCORE_DIGITS, RowScore

# The functions below travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRIP = 128
_COUNT_CELLS = 2_000_000
_SLACK = 1e-6
_MOST_KNOWN = 200_000


def match_whole_groups(row_score: RowScore, left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    """Matches of prepared sides with a ``key``; the caller bounds the rows of a key."""
    compare = comparer(row_score)

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        pairs = greedy_pass(a.sort_by([("left_id", "descending")]), b.sort_by([("right_id", "descending")]), compare)
        return pa.table({"left_id": pa.array(pairs[0], pa.int64()), "right_id": pa.array(pairs[1], pa.int64()), "score": pa.array(np.ones(len(pairs[0])))})

    sides = [df.repartition(tasks, "key").groupBy("key") for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: solve(a, b), "left_id long, right_id long, score double")


def greedy_pass(a: pa.Table, b: pa.Table, compare: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Matched positions of two sides that are sorted from the highest position down."""
    lefts, rights = [], []
    if a.num_rows and b.num_rows:
        passes, most = compare(a, b)
        strip = max(1, min(STRIP, most))
        free = np.arange(b.num_rows)
        for begin in range(0, a.num_rows, strip):
            waiting, used, low = np.arange(begin, min(begin + strip, a.num_rows)), [], 0
            while low < len(free) and len(waiting):
                window = free[low : low + strip]
                passing, open_, left_over = passes(waiting, window), np.ones(len(window), bool), []
                for row, fits in zip(waiting.tolist(), passing):
                    fits = fits & open_
                    j = int(fits.argmax())
                    if fits[j]:
                        open_[j] = False
                        lefts.append(row)
                        rights.append(int(window[j]))
                        used.append(low + j)
                    else:
                        left_over.append(row)
                waiting, low = np.array(left_over, np.int64), low + strip
            free = np.delete(free, used)
    return a["left_id"].to_numpy()[lefts], b["right_id"].to_numpy()[rights]


def comparer(row_score: RowScore) -> Callable:
    """``compare(left table, right table)`` gives a function of rows of both to a matrix of whether they pass, and
    how many rows of a side it may be given. It follows ``RowScore.passing`` with equal identifiers step by step."""
    fields, threshold = [(i, f.kind, f.weight) for i, f in enumerate(row_score.fields)], row_score.threshold
    spelled: dict[tuple[str, str], float] = {}

    def spelling(x: list, y: list) -> np.ndarray:
        if len(spelled) > _MOST_KNOWN:
            spelled.clear()
        new = [p for p in dict.fromkeys(zip(x, y)) if p not in spelled]
        if new:
            spelled.update(zip(new, _jaro_winklers([p[0] for p in new], [p[1] for p in new]).tolist()))
        return np.array([spelled[p] for p in zip(x, y)])

    def compare(a: pa.Table, b: pa.Table) -> tuple[Callable, int]:
        grams = _Grams(a["left_text"].to_pylist() + b["right_text"].to_pylist())
        columns = {}
        for i, kind, _ in fields:
            if kind == "number":
                columns[i] = [t[f"{s}{i}"].to_numpy() for t, s in ((a, "l"), (b, "r"))]
            elif kind == "text":
                coded = [t[f"{s}{i}"].combine_chunks().dictionary_encode() for t, s in ((a, "l"), (b, "r"))]
                columns[i] = [(c.dictionary.to_pylist(), c.indices.fill_null(-1).to_numpy().astype(np.int64)) for c in coded]

        def terms(i: int, kind: str, weight: float, x: np.ndarray, y: np.ndarray, measured: bool) -> tuple[np.ndarray, np.ndarray]:
            """Weighted similarity and weight of a field, of rows that broadcast; 1 for a text that is not measured."""
            if kind == "id":
                return np.float64(weight), np.float64(weight)
            if kind == "number":
                p, q = columns[i][0][x], columns[i][1][y]
                largest = np.maximum(np.abs(p), np.abs(q))
                with np.errstate(invalid="ignore", divide="ignore"):
                    same = np.where(largest == 0, 1.0, 1.0 - np.abs(p - q) / largest)
                known = ~(np.isnan(p) | np.isnan(q))
            else:
                (names, p), (others, q) = columns[i]
                p, q = p[x], q[y]
                known = (p >= 0) & (q >= 0)
                same = np.ones(known.shape)
                if measured and known.any():
                    pairs, number = np.unique(p[known] * len(others) + q[known], return_inverse=True)
                    same[known] = spelling([names[k] for k in (pairs // len(others)).tolist()], [others[k] for k in (pairs % len(others)).tolist()])[number]
            return np.where(known, same * weight, 0.0), np.where(known, weight, 0.0)

        def field(x: np.ndarray, y: np.ndarray, measured: bool) -> np.ndarray:
            total = weights = 0.0
            for f in fields:
                got, weight = terms(*f, x, y, measured)
                total, weights = total + got, weights + weight
            return total / weights

        def passes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            p, q = grams.counts(x), grams.counts(y + a.num_rows)
            norms = np.einsum("ij,ij->i", p, p)[:, None] * np.einsum("ij,ij->i", q, q)[None, :]
            # Not the threaded matrix product: each core has a worker of its own already.
            cosine = np.einsum("ij,kj->ik", p, q) / np.sqrt(norms)
            near = ~(cosine * EMBEDDING_WEIGHT + field(x[:, None], y[None, :], False) * FIELD_WEIGHT < threshold - _SLACK)
            i, j = np.nonzero(near)
            score = cosine[i, j] * EMBEDDING_WEIGHT + field(x[i], y[j], True) * FIELD_WEIGHT
            near[i, j] = _reaches(np.broadcast_to(score, i.shape), threshold)
            return near

        return passes, _COUNT_CELLS // grams.width

    return compare


def _reaches(score: np.ndarray, threshold: float) -> np.ndarray:
    """Whether scores reach the threshold as they are compared, rounded half up."""
    reached = ~(score < threshold)
    for k in np.flatnonzero(np.abs(score - threshold) < 10.0 ** (1 - SCORE_DIGITS)).tolist():
        rounded = Decimal(repr(float(score[k]))).quantize(Decimal(1).scaleb(-SCORE_DIGITS), ROUND_HALF_UP)
        reached[k] = float(rounded) >= threshold
    return reached
