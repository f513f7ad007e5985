"""Similarity of two values: Jaro-Winkler, character-bigram cosine, vectors and numbers.

The two string measures have no built-in form in Spark, so they are Arrow
UDFs over whole batches; the rest are column expressions.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions below travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the published Jaro-Winkler measure.
BOOST_THRESHOLD = 0.7
PREFIX_LENGTH = 4
PREFIX_WEIGHT = 0.1

_CHARS_PER_STEP = 1_000_000
_CELLS_PER_STEP = 200_000
_TABLE_SIZE = 4_000_000
_DENSE_FACTOR = 4
_BATCH_ROWS = 6  # times the length: fewer texts are faster one by one
_LENGTH_CLASSES = (8, 16, 24, 32, 48, 64)


def _jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler by code point, in time linear in the two lengths.

    The window's lower end only moves forward and, per character, positions in ``b``
    are taken in order, so one forward cursor per character finds every match.
    """
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    places = defaultdict(list)
    for j, ch in enumerate(b):
        places[ch].append(j)
    cursor = dict.fromkeys(places, 0)
    left, right = [], []
    for i, ch in enumerate(a):
        spots = places.get(ch)
        if spots is None:
            continue
        at = cursor[ch]
        while at < len(spots) and spots[at] < i - window:
            at += 1
        if at < len(spots) and spots[at] <= i + window:
            left.append(ch)
            right.append(spots[at])
            at += 1
        cursor[ch] = at
    m = len(left)
    if not m:
        return 0.0
    right.sort()
    half_swaps = sum(x != b[j] for x, j in zip(left, right)) // 2
    score = (m / len(a) + m / len(b) + (m - half_swaps) / m) / 3
    if score > BOOST_THRESHOLD:
        prefix = 0
        for x, y in zip(a[:PREFIX_LENGTH], b[:PREFIX_LENGTH]):
            if x != y:
                break
            prefix += 1
        score += PREFIX_WEIGHT * prefix * (1 - score)
    return score


def _characters(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """One column of code points per text, padded, and the lengths."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    inside = np.arange(lengths.max()) < lengths[:, None]
    codes = np.full(inside.shape, pad, dtype=np.uint32)
    codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    narrow = codes.astype(np.uint8) if pad < 256 else codes
    return np.ascontiguousarray(narrow.T), lengths


def _jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler of many pairs of short, non-empty texts, one pair of positions at a time."""
    # The two paddings are no characters of the texts and equal nothing.
    latin = all(t.isascii() for t in a) and all(t.isascii() for t in b)
    pads = (0xFE, 0xFF) if latin else (0x110000, 0x110001)
    (x, len_x), (y, len_y) = _characters(a, pads[0]), _characters(b, pads[1])
    window = np.maximum(np.maximum(len_x, len_y) // 2 - 1, 0)
    reach = int(window.max())
    within = [window >= d for d in range(reach + 1)]
    always = [bool(w.all()) for w in within]
    free = np.ones(y.shape, dtype=bool)
    hit_x = np.empty(x.shape, dtype=bool)
    for i in range(len(x)):
        seeking = np.ones(len(a), dtype=bool)
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            hits = x[i] == y[j]
            hits &= free[j]
            hits &= seeking
            if not always[abs(i - j)]:
                hits &= within[abs(i - j)]
            free[j] ^= hits
            seeking ^= hits
        np.logical_not(seeking, out=hit_x[i])
    m = hit_x.sum(axis=0)
    # Text by text and in order, both sides list the same number of matched characters.
    moved = np.repeat(np.arange(len(a)), m)[x.T[hit_x.T] != y.T[~free.T]]
    half_swaps = np.bincount(moved, minlength=len(a)) // 2
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / len_x + m / len_y + (m - half_swaps) / some) / 3, 0.0)
    ends = min(PREFIX_LENGTH, len(x), len(y))
    prefix = np.logical_and.accumulate(x[:ends] == y[:ends], axis=0).sum(axis=0)
    return np.where(score > BOOST_THRESHOLD, score + PREFIX_WEIGHT * prefix * (1 - score), score)


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """Short texts together, by length class; long ones, and small classes, one by one."""
    longest = np.fromiter((max(len(x), len(y)) if x and y else 0 for x, y in zip(a, b)), dtype=np.int64, count=len(a))
    out = np.zeros(len(a))
    low, single = 0, []
    for high in (*_LENGTH_CLASSES, None):
        rows = np.flatnonzero((longest > low) & (longest <= high) if high else longest > low)
        if high and len(rows) >= _BATCH_ROWS * high:
            out[rows] = _jaro_winkler_batch([a[i] for i in rows], [b[i] for i in rows])
        else:
            single.append(rows)
        low = high
    for i in np.concatenate(single):
        out[i] = _jaro_winkler(a[i], b[i])
    return out


@F.arrow_udf(T.DoubleType())
def _jaro_winkler_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Each distinct pair of texts in the batch is measured once."""
    a, b = a.dictionary_encode(), b.dictionary_encode()
    left, right = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    if not left or not right:
        return pa.nulls(len(a), pa.float64())
    missing = np.asarray(a.is_null()) | np.asarray(b.is_null())
    x, y = (np.asarray(d.indices.fill_null(0), dtype=np.int64) for d in (a, b))
    distinct, place = np.unique(x * len(right) + y, return_inverse=True)
    scores = _jaro_winklers([left[i] for i in distinct // len(right)], [right[i] for i in distinct % len(right)])
    return pa.array(scores[place], mask=missing)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity; null if either text is null, 0 if either is empty."""
    return _once(_jaro_winkler_udf)(a, b)


def _once(udf):
    """Keep a filter on the result from being pushed below it, which would run it twice."""
    return udf.asNondeterministic()


def _renumber(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The values numbered 0.. in rising order, and how many there are."""
    top = int(values.max()) + 1
    if top > _TABLE_SIZE:
        distinct, place = np.unique(values, return_inverse=True)
        return place, len(distinct)
    seen = np.zeros(top, dtype=bool)
    seen[values] = True
    numbers = np.cumsum(seen) - 1
    return numbers[values], int(numbers[-1]) + 1


class _Grams:
    """The bigrams of texts: per text a run of numbers below ``width``."""

    def __init__(self, texts: list[str]):
        padded = [f" {t} " for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(texts))
        starts = np.ones(len(chars), dtype=bool)
        starts[np.cumsum(lengths) - 1] = False
        first = np.flatnonzero(starts)
        letters, size = _renumber(chars)
        self.grams, self.width = _renumber(letters[first] * size + letters[first + 1])
        self.ends = np.cumsum(lengths - 1)
        self.sizes = lengths - 1

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """One row of counts per listed text."""
        sizes = self.sizes[texts]
        upto = np.cumsum(sizes)
        place = np.arange(upto[-1]) + np.repeat(self.ends[texts] - upto, sizes)
        cells = np.repeat(np.arange(len(texts)) * self.width, sizes) + self.grams[place]
        flat = np.bincount(cells, minlength=len(texts) * self.width).astype(float)
        return flat.reshape(len(texts), self.width)


def _bigram_cosines(left: list[str], right: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs ``left[a], right[b]``; each text is counted once per step.

    All sums are of whole numbers, so their order does not matter.
    """
    n = len(a)
    grams = _Grams(left + right)
    out = np.empty(n)
    part = max(1, _CELLS_PER_STEP // grams.width)
    step = n if (len(left) + len(right)) * grams.width <= _TABLE_SIZE else part
    for low in range(0, n, step):
        (l, i), (r, j) = (np.unique(ids[low : low + step], return_inverse=True) for ids in (a, b))
        x, y = grams.counts(l), grams.counts(r + len(left))
        if len(l) * len(r) <= _DENSE_FACTOR * len(i):
            # Not the threaded matrix product: each core has a worker of its own already.
            dots = np.einsum("ij,kj->ik", x, y)[i, j]
        else:
            dots = np.concatenate(
                [np.einsum("ij,ij->i", x[i[k : k + part]], y[j[k : k + part]]) for k in range(0, len(i), part)]
            )
        norms = np.einsum("ij,ij->i", x, x)[i] * np.einsum("ij,ij->i", y, y)[j]
        out[low : low + step] = dots / np.sqrt(norms)
    return out


@F.arrow_udf(T.DoubleType())
def _bigram_cosine_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Steps hold whole pairs and a bounded number of characters (or one pair)."""
    known = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
    out = np.full(len(a), np.nan)
    a, b = a.take(pa.array(known)), b.take(pa.array(known))
    size = np.cumsum(np.asarray(pc.add(pc.utf8_length(a), pc.utf8_length(b)), dtype=np.int64))
    begin = 0
    while begin < len(known):
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + _CHARS_PER_STEP, side="right")))
        x, y = (side.slice(begin, end - begin).dictionary_encode() for side in (a, b))
        places = (np.asarray(d.indices, dtype=np.int64) for d in (x, y))
        out[known[begin:end]] = _bigram_cosines(x.dictionary.to_pylist(), y.dictionary.to_pylist(), *places)
        begin = end
    return pa.array(out, mask=np.isnan(out))


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the two texts' character-bigram counts."""
    return _once(_bigram_cosine_udf)(a, b)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 where either is all zeros."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def numeric_closeness(a: Column, b: Column) -> Column:
    """One minus the difference relative to the larger magnitude; 1 if both are 0."""
    a, b = a.cast("double"), b.cast("double")
    largest = F.greatest(F.abs(a), F.abs(b))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.when(largest == 0, F.lit(1.0)).otherwise(1.0 - F.abs(a - b) / largest))
