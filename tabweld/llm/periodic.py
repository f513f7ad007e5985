"""Periodic runs of words by suffix trees with constant-time longest common extensions.

A run is a stretch of words with smallest period q that is at least twice as long as q, and that no
neighbouring word extends. For each document:

1. Stretches. In a run every word comes back, so a word that occurs once in a stretch ends it. The
   text is cut at such words until every word of a stretch occurs twice in it; no run is lost.
2. Trees. Ukkonen's algorithm builds the suffix tree of a stretch and that of its reversal. An Euler
   tour with minima of blocks answers the string depth of the lowest common ancestor of two leaves,
   which is the longest common extension of two places, in constant time.
3. Lyndon roots. The order of the leaves ranks the suffixes, for the order of the words and for its
   reverse. The next suffix of a smaller rank ends the longest Lyndon word of a place. Every run has
   such a word of its period's length as a root, for one of the two orders.
4. Each root is extended both ways; it is a run if the stretch has twice the root's length.

A task holds one document and the trees of one stretch at a time: memory is linear in the longest
stretch of repeated words, about 1 KB a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import ship_by_value

SHORTEST = 12
BLOCK = 16

ship_by_value(__name__)


def stretches(words: list, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Parts (from, to) of ``words`` outside which there is no run of ``shortest`` words or more."""
    out, open_parts = [], [(0, len(words))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < max(2, shortest):
            continue
        part = words[low:high]
        once = {w for w, n in Counter(part).items() if n == 1}
        if not once:
            out.append((low, high))
            continue
        start = low
        for i, w in enumerate(part, low):
            if w in once:
                open_parts.append((start, i))
                start = i + 1
        open_parts.append((start, high))
    return sorted(out)


def ukkonen(text: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Suffix tree of ``text`` (numbers; the last one unique): edges by ``node * width + symbol``, and their bounds."""
    n, width = len(text), max(text) + 1
    start, end, link, edges = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for at, symbol in enumerate(text):
        last = 0
        waiting += 1
        while waiting:
            if not length:
                edge = at
            key = node * width + text[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(at)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = 0
            else:
                begin = start[child]
                stop = end[child]
                size = (stop if stop <= at else at + 1) - begin
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if text[begin + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                start += (begin, at)
                end += (begin + length, n)
                link += (0, 0)
                edges[key] = split
                start[child] = begin + length
                edges[split * width + symbol] = split + 1
                edges[split * width + text[begin + length]] = child
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = at - waiting + 1
    return edges, start, end


class Extensions:
    """Longest common extensions of the places of a text, and its suffixes' ranks for both orders."""

    def __init__(self, text: list[int], ranks: bool):
        n = len(text) + 1
        text = [*text, 0]  # the end: a symbol of its own, below all others
        edges, start, end = ukkonen(text)
        width, nodes = max(text) + 1, len(start)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        child = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        from_child = np.searchsorted(keys[order] // width, np.arange(nodes + 1)).tolist()
        del edges, keys, order
        size = [b - a for a, b in zip(start, end)]
        depth, first, tour = [0] * nodes, [0] * n, []
        todo = [0]
        while todo:
            v = todo.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            a, b = from_child[v], from_child[v + 1]
            if a == b:
                first[n - d] = len(tour)
                tour.append(d)
                continue
            tour.append(d)
            for c in reversed(child[a:b]):
                depth[c] = d + size[c]
                todo += (~v, c)
        self.first = np.array(first)
        self.ranks: list[list[int]] = []
        if ranks:
            up = np.empty(n, np.int64)
            up[np.argsort(self.first)] = np.arange(n)
            down, k, todo = [0] * n, 0, [0]
            while todo:
                v = todo.pop()
                a, b = from_child[v], from_child[v + 1]
                if a == b:
                    down[n - depth[v]] = k
                    k += 1
                elif text[start[child[a]]]:
                    todo += child[a:b]
                else:  # the end comes first in either order
                    todo += child[a + 1 : b]
                    todo.append(child[a])
            self.ranks = [up.tolist(), down]
        # Minima of blocks, of their beginnings and ends, and of 2^k blocks.
        blocks = -(-len(tour) // BLOCK)
        padded = np.full(blocks * BLOCK, n, np.int32)
        padded[: len(tour)] = tour
        table = padded.reshape(blocks, BLOCK)
        self.tour = padded
        self.ahead = np.minimum.accumulate(table, axis=1).ravel()
        self.behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [table.min(axis=1)]
        while 2 << len(self.levels) - 1 <= blocks:
            half, low = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the texts from ``a`` and from ``b`` agree."""
        low, high = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b])
        one, two = low // BLOCK, high // BLOCK
        out = np.minimum(self.behind[low], self.ahead[high])
        same = np.flatnonzero(one == two)
        if len(same):
            places = low[same, None] + np.arange(BLOCK)
            inside = np.minimum(places, high[same, None])
            out[same] = self.tour[inside].min(axis=1)
        wide = np.flatnonzero(two - one > 1)
        if len(wide):
            x, y = one[wide] + 1, two[wide]
            level = np.frexp(y - x)[1] - 1
            for k in np.unique(level).tolist():
                at = wide[level == k]
                x, y = one[at] + 1, two[at]
                out[at] = np.minimum(out[at], np.minimum(self.levels[k][x], self.levels[k][y - (1 << k)]))
        return out


def lyndon_words(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word from each place: up to the next suffix of a smaller rank."""
    n = len(rank) - 1
    out, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        own = rank[i]
        while rank[stack[-1]] > own:
            stack.pop()
        out[i] = stack[-1] - i
        stack.append(i)
    return np.array(out)


def runs_of_stretch(text: list[int], shortest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text of numbers from 1 on."""
    n = len(text)
    forward, backward = Extensions(text, True), Extensions(text[::-1], False)
    found = []
    for rank in forward.ranks:
        period = lyndon_words(rank)
        i = np.arange(n)
        right = forward.common(i, i + period)
        left = backward.common(n - i, n - i - period)
        length = left + period + right
        good = (length >= 2 * period) & (length >= shortest)
        found.append(np.stack([i - left, length, period], axis=1)[good])
    return np.unique(np.concatenate(found), axis=0)


def runs(words: list, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``shortest`` words, by start, then period."""
    out = []
    for low, high in stretches(words, shortest):
        codes: dict = {}
        text = [codes.setdefault(w, len(codes) + 1) for w in words[low:high]]
        out += [(low + s, m, p) for s, m, p in runs_of_stretch(text, shortest).tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words that no run holds behind its first period."""
    if not found:
        return words
    gone = bytearray(len(words))
    for start, length, period in found:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def with_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period) and ``collapsed`` (the kept words) of every document.

    Words are stretches without ASCII white space, numbered from 0. Null and empty texts have no words,
    no runs and an empty collapsed text. Each row gives a row, null and repeated ids too; an empty table
    gives an empty one. Other columns are ignored. Runs that overlap are all reported, and a word goes
    if any of them repeats it.
    """
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256)
                sizes, spans, left = [], [], []
                for text in part:
                    words = (text.as_py() or b"").split()  # of bytes: ASCII white space only
                    found = runs(words, shortest)
                    sizes.append(len(words))
                    spans.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                    left.append(b" ".join(without_repeats(words, found)))
                collapsed = pa.array(left, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(sizes, pa.int64()), pa.array(spans, kind), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    doc_id = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(run, f"doc_id {doc_id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period) and hashes of runs and kept words."""
    rows = with_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text``; every tenth document, by a hash of its id, continues with a period from some word on.

    With h the CRC-32 of the id in decimals, g = h div 10, and n words: if h % 10 = 0, each word i >= a
    becomes the original word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).
    Documents without an id, or without words, stay as they are.
    """
    doc_id, text = F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    rows = docs.select(doc_id, text, F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rows = rows.withColumn("w", F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN g % size(w) END"))
    rows = rows.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    periodic = "array_join(transform(sequence(0, size(w) - 1), i -> get(w, cast(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int))), ' ')"
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.expr(periodic)).otherwise(F.col("text")).alias("text"))
