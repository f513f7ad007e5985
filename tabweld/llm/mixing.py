"""Mixing sources to target weights: Pfair schedules interleave blocks of documents.

The documents of a source, in a random but fixed order, are cut into blocks of ``block_rows``.
A source with weight ``a`` out of ``D`` (the sum of the whole-number weights of all sources that
still have blocks) gives its ``k``-th block the release time ``floor(k * D / a)`` and the deadline
``ceil((k + 1) * D / a)``. In each slot the released block with the earliest deadline is taken;
with these windows every deadline is met, so after any number of slots a source is less than one
block away from its share. When a source has no blocks left, the rest continue from there with
their weights out of the smaller sum: a phase ends and the next begins. Every document appears
exactly once.

Schedules repeat after ``D`` slots, so one period per phase and the piece up to the phase's end
describe them. These tables hold no slot that no block takes: at most one entry per block, and with
few sources far fewer, whatever the number of sources and their weights. Up to ``MOST_ENTRIES``
entries are broadcast; more become a written table with a row for each block, joined on source and
block. Ranks inside a source come from hash ranges
of bounded size, so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweld.llm.common import replaced, with_row
from tabweld.session import materialize

#: Sum of default weights, smallest target of a run of equal hash prefixes, and the most entries of
#: schedules (and sources) that are broadcast instead of joined.
PARTS = 1000
RANGE_ROWS = 2048
MOST_ENTRIES = 1 << 18

PIECES = "source_no int, phase int, phase_start long, start_slot long, start_block long, first_block long, last_block long, weight long, total long, slots array<long>"


def smoothed_weights(rows: Mapping[str | None, int], power: float = 0.7, parts: int = PARTS) -> dict[str | None, int]:
    """Whole weights in proportion to ``rows ** power`` (small sources get more than their share)."""
    parts = max(parts, len(rows))
    raw = {s: n**power for s, n in rows.items()}
    spare, whole = parts - len(rows), sum(raw.values())
    exact = {s: spare * x / whole for s, x in raw.items()}
    weights = {s: 1 + math.floor(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s is None, s or ""))
    for s in by_rest[: parts - sum(weights.values())]:
        weights[s] += 1
    return weights


def deadline_order(classes: Mapping[int, list[int]], total: int) -> Iterator[int]:
    """The source that gets each slot, without end; ``classes`` lists the sources of each weight, ascending.

    A class enters a source only when the one before it has its first block: sources of one weight
    start in their order, so that a phase of few slots costs few steps, however many sources live.
    """
    ready = [(-(-total // w), own[0], 0, w, 0) for w, own in classes.items() if own]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int, int]] = []
    for now in itertools.count():
        while waiting and waiting[0][0] <= now:
            _, i, k, w = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // w), i, k, w, -1))
        _, i, k, w, n = heapq.heappop(ready)
        yield i
        heapq.heappush(waiting, ((k + 1) * total // w, i, k + 1, w))
        if 0 <= n < len(classes[w]) - 1:
            heapq.heappush(ready, (-(-total // w), classes[w][n + 1], 0, w, n + 1))


def by_weight(weights: list[int], live: Iterable[int]) -> dict[int, list[int]]:
    classes: dict[int, list[int]] = {}
    for i in live:
        classes.setdefault(weights[i], []).append(i)
    return classes


def earliest_deadlines(weights: list[int], slots: int) -> list[int]:
    """The source that gets each slot; ``weights`` are positive and ``slots`` at most their sum."""
    return list(itertools.islice(deadline_order(by_weight(weights, range(len(weights))), sum(weights)), slots))


def schedule(blocks: list[int], weights: list[int]) -> list[tuple]:
    """Rows of ``PIECES``: for each phase and source, the repeated periods and the last piece.

    Block ``b`` of a piece, counted from its ``first_block`` as ``r``, has the slot
    ``start_slot + (r div len(slots)) * total + slots[r mod len(slots)]``. Only slots that are taken
    are computed, so time and entries grow with the blocks at most.
    """
    done = [0] * len(blocks)
    classes = by_weight(weights, (i for i, n in enumerate(blocks) if n))
    total = sum(w * len(own) for w, own in classes.items())
    # What is left of a source, plus its blocks in all full periods so far: these change it not.
    virtual, full = list(blocks), 0
    ends = [(n // weights[i], i) for i, n in enumerate(blocks) if n]
    heapq.heapify(ends)
    pieces, start, phase = [], 0, 0

    def left(i: int) -> int:
        return virtual[i] - full * weights[i]

    while total:
        while ends[0][0] != virtual[ends[0][1]] // weights[ends[0][1]] or not left(ends[0][1]):
            heapq.heappop(ends)
        periods, begin, first = ends[0][0] - full, start, {}
        order, ended = deadline_order(classes, total), []
        known: list[int] = []
        if periods:
            known = list(itertools.islice(order, total))
            places: dict[int, list[int]] = {}
            for slot, i in enumerate(known):
                places.setdefault(i, []).append(slot)
            full += periods
            for i in sorted(places):
                n, first[i] = periods * weights[i], done[i]
                pieces.append((i, phase, begin, start, first[i], done[i], done[i] + n, weights[i], total, places[i]))
                done[i] += n
                if not left(i):
                    ended.append(i)
            start += periods * total
        tail, tail_start = {}, start
        if not ended:
            for slot, i in enumerate(known or order):
                tail.setdefault(i, []).append(slot)
                virtual[i] -= 1
                if not left(i):
                    ended.append(i)
                    start += slot + 1
                    break
        for i in sorted(tail):
            n = len(tail[i])
            pieces.append((i, phase, begin, tail_start, first.get(i, done[i]), done[i], done[i] + n, weights[i], total, tail[i]))
            done[i] += n
            heapq.heappush(ends, (virtual[i] // weights[i], i))
        for i in ended:
            own = classes[weights[i]]
            del own[bisect.bisect_left(own, i)]
            total -= weights[i]
        phase += 1
    return pieces


def mixed(
    docs: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    block_rows: int = 16,
    source_column: str = "source",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``row`` (all columns), ``source``, ``block``, ``place`` (in the block), ``phase``, ``release``,
    ``deadline`` and ``slot``, for every document.

    Without ``weights`` the sources' sizes are smoothed (``smoothed_weights``). A source that
    ``weights`` does not name has weight 1; weights must be whole and positive. Null is a source
    like any other. Equal rows get different places; which of them comes first does not matter.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    code = F.xxhash64(*(F.col(f"`{c}`") for c in (id_column, text_column) if c in docs.columns))
    rows = with_row(docs, source=F.col(f"`{source_column}`").cast("string"), code=code)

    # One line per source: the number of sources, not of documents, bounds what the driver sees.
    counted = sorted(rows.groupBy("source").count().collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = {r.source: r["count"] for r in counted}
    weights = smoothed_weights(sizes) if weights is None and sizes else dict(weights or {})
    own = [weights.get(s, 1) for s in sizes]
    if any(w != int(w) or w < 1 for w in own):
        raise ValueError("weights must be whole numbers of at least 1")
    pieces = schedule([-(-n // block_rows) for n in sizes.values()], [int(w) for w in own])
    few = len(sizes) + sum(len(p[-1]) for p in pieces) <= MOST_ENTRIES
    bits = [max(0, (n // RANGE_ROWS).bit_length()) for n in sizes.values()]
    sources = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(sizes, bits))], "source_no int, name string, bits int")
    pieces = spark.createDataFrame(pieces, PIECES)
    if few:
        sources, pieces = F.broadcast(sources), F.broadcast(pieces)
    else:
        sources = materialize(sources, "mixed-sources")

    # Hash prefixes split every source into ranges of about RANGE_ROWS rows.
    part = F.expr("case when bits = 0 then 0L else shiftrightunsigned(code, 64 - bits) end")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("part", part)
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source_no", "part").count()
    parts = parts.select("source_no", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("source_no", "part").orderBy("code")
    ranked = rows.withColumn("n", F.row_number().over(inside)).join(parts, ["source_no", "part"])
    rank = F.col("rows_before") + F.col("n") - 1
    blocked = ranked.select(
        "row",
        "source",
        "source_no",
        F.expr(f"(rows_before + n - 1) div {block_rows}").alias("block"),
        (rank % block_rows).cast("int").alias("place"),
    )
    if few:
        pieces = pieces.withColumnRenamed("source_no", "piece_source")
        timed = blocked.join(pieces, (F.col("source_no") == F.col("piece_source")) & (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("last_block")))
        return timed.select("row", "source", "block", "place", *times())
    slots = pieces.withColumn("block", F.explode(F.sequence("first_block", F.col("last_block") - 1))).select("source_no", "block", *times())
    timed = blocked.join(materialize(slots, "mixed-slots"), ["source_no", "block"])
    return timed.select("row", "source", "block", "place", "phase", "release", "deadline", "slot")


def times() -> list[Column]:
    """``phase``, ``release``, ``deadline`` and ``slot`` of a ``block`` in its piece."""
    return [
        F.col("phase"),
        F.expr("phase_start + ((block - start_block) * total) div weight").alias("release"),
        F.expr("phase_start + ((block - start_block + 1) * total + weight - 1) div weight").alias("deadline"),
        F.expr("start_slot + ((block - first_block) div size(slots)) * total + slots[cast((block - first_block) % size(slots) as int)]").alias("slot"),
    ]


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, ordered by slot and place: the files hold the mixture."""
    return mixed(docs, **options).orderBy("slot", "place").select(*replaced(docs))


def with_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """The documents and their place in the whole mixture, from 0, read off the files of ``in_mixed_order``.

    ``docs`` must be what a file reader returns. Readers pack files by size, so that a later
    stage sees the mixture only in this column. One line per file reaches the driver.
    """
    file, row = docs.metadataColumn("_metadata")["file_name"], docs.metadataColumn("_metadata")["row_index"]
    placed = docs.select("*", file.alias(f"{name} file"), row.alias(f"{name} row"))
    counted = sorted(placed.groupBy(f"{name} file").count().collect(), key=lambda r: (len(r[0]), r[0]))
    before = itertools.accumulate((r["count"] for r in counted), initial=0)
    starts = docs.sparkSession.createDataFrame([(r[0], n) for r, n in zip(counted, before)], f"`{name} file` string, `{name} start` long")
    whole = placed.join(F.broadcast(starts), f"{name} file")
    return whole.select(*(f"`{c.replace('`', '``')}`" for c in docs.columns), (F.col(f"`{name} start`") + F.col(f"`{name} row`")).alias(name))
