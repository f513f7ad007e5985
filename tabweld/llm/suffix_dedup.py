"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

A sparse suffix array finds them. Places are sampled by content: every window of ``length`` bytes
picks the 100-byte gram in it with the smallest hash (the first of equals), so equal windows pick
the same gram at the same offset. Consecutive windows mostly pick the same place, its *anchor*; the
bytes of the windows of one anchor are its *context*.

1. Anchors whose gram occurs once have no repeated window. This is counted over all texts.
2. Contexts that occur twice or more, byte for byte, are repeated as a whole.
3. Different contexts with the same gram are suffixes to sort, from their anchors on: multikey
   quicksort by characters of eight bytes to ``SHALLOW`` bytes, then blind tries order the groups
   that still agree. A window that begins ``d`` bytes before the anchor is repeated if some other
   context agrees in ``d`` bytes before and ``length - d`` from the anchor; going out from a context
   in suffix order the common length falls, which ends the search early.
4. Grams with more than ``GROUP_CONTEXTS`` different contexts are not sorted in one task: their
   contexts are cut into runs of windows, grouped by the bytes that all windows of a run share, and
   equal pieces combined, down to single windows if need be. That is exact, and no group is left
   out.

Copies of a text count once in 1 to 4 and are removed whole if they are long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import ship_by_value, whole_text
from tabweld.session import materialize

LENGTH = 400
GRAM = 100
SHALLOW = 128
GROUP_CONTEXTS = 512
BLOCKS = (64, 16, 4, 1)
#: Texts are hashed in runs of this many windows.
RUN = 1 << 20

ship_by_value(__name__)


class Hasher:
    """Rolling hashes of all grams of a text: sums of keyed bytes times powers modulo 2^64."""

    def __init__(self, seed: int, most: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.powers = powers(base, most)
        self.inverse = powers(pow(base, -1, 1 << 64), most)

    def grams(self, text: np.ndarray, size: int) -> np.ndarray:
        n = len(text)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[text] * self.powers[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.inverse[: n - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def powers(base: int, most: int) -> np.ndarray:
    out = np.full(most, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, hasher: Hasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash and place of each anchor, and the first window of its run (the run ends where the
    next one begins)."""
    hashes, places, firsts = [], [], []
    raw = np.frombuffer(text, np.uint8)
    windows = len(raw) - length + 1
    low = np.uint64(RUN * 2 - 1)
    for begin in range(0, windows, RUN):
        part = raw[begin : min(begin + RUN, windows) + length - 1]
        h = hasher.grams(part, gram)
        marked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        at = (window_minima(marked, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        hashes.append(h[at[first]].view(np.int64))
        places.append(at[first] + begin)
        firsts.append(first + begin)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(firsts)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie_order(texts: list[bytes], own: list[int]) -> list[int]:
    """Order of texts by a blind trie: inner nodes hold a length and a child for each next byte;
    what lies between is not stored but compared once, with one leaf, on insertion."""

    def byte_at(i: int, k: int) -> int:
        return texts[i][k] if k < len(texts[i]) else -1

    root: list | int | None = None
    same: dict[int, list[int]] = {}
    for i in own:
        if root is None:
            root, same[i] = i, [i]
            continue
        node = root
        while isinstance(node, list):
            child = node[1].get(byte_at(i, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        leaf = node
        n = common_prefix(texts[i], texts[leaf])
        if n == len(texts[i]) == len(texts[leaf]):
            same[leaf].append(i)
            continue
        same[i] = [i]
        parent, node = None, root
        while isinstance(node, list) and node[0] < n:
            parent, node = node, node[1][byte_at(i, node[0])]
        if isinstance(node, list) and node[0] == n:
            node[1][byte_at(i, n)] = i
            continue
        branch = [n, {byte_at(i, n): i, byte_at(leaf, n): node}]
        if parent is None:
            root = branch
        else:
            parent[1][byte_at(i, parent[0])] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        elif node is not None:
            out.extend(same[node])
    return out


def suffix_order(texts: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Deep-shallow sorting: multikey quicksort, then blind tries for what agrees in ``shallow`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        own, depth = stack.pop()
        if len(own) <= 1:
            out.extend(own)
        elif depth >= shallow:
            out.extend(blind_trie_order(texts, own))
        else:
            pivot = texts[own[len(own) // 2]][depth : depth + 8]
            less, equal, more = [], [], []
            for i in own:
                key = texts[i][depth : depth + 8]
                (equal if key == pivot else less if key < pivot else more).append(i)
            # Texts that end inside the pivot's character are equal to each other.
            stack.append((more, depth))
            stack.append((equal, depth + 8 if len(pivot) == 8 else shallow))
            stack.append((less, depth))
    return out


def repeated_windows(contexts: list[bytes], offsets: list[int], wanted: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For each wanted context, ranges (first, last) of its windows that another context has too."""
    after = [c[o:] for c, o in zip(contexts, offsets)]
    before = [c[:o][::-1] for c, o in zip(contexts, offsets)]
    order = suffix_order(after)
    shared = [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for at, i in enumerate(order):
        if not wanted[i]:
            continue
        most = offsets[i]
        for step in (-1, 1):
            right, reach, k = len(after[i]), -1, at
            while 0 <= k + step < len(order) and reach < most:
                right = min(right, shared[k - 1 if step < 0 else k])
                k += step
                least = length - right
                if least > most:
                    break
                left = common_prefix(before[i], before[order[k]])
                if left > reach and left >= least:
                    out[i].append((most - left, most - max(least, 0)))
                    reach = left
    return out


def text_key(text) -> list:
    """Two columns that tell texts apart: a hash and the number of bytes."""
    return [F.xxhash64(text).alias("code"), F.octet_length(text).alias("n_bytes")]


def text_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One line per different text: ``code, n_bytes, first_id, copies`` and its anchors."""
    text = whole_text(F.col("text"))
    slim = docs.select(*text_key(text), "doc_id", F.encode(text, "UTF-8").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1, RUN + length)
        lists = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(3)
            found = [anchors(texts[i].as_py(), hasher, length, gram) for i in range(len(texts))]
            sizes = [len(f[0]) for f in found]
            last = [n - length + 1 for n in batch.column(1).to_pylist()]
            ends = [np.append(f[2][1:], n) if len(f[2]) else f[2] for f, n in zip(found, last)]
            flat = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)]
            flat.append(np.concatenate(ends or [np.zeros(0, np.int64)]))
            values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in flat], fields=list(lists.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, values)], ["code", "n_bytes", "doc_id", "anchors"])

    each = slim.mapInArrow(run, f"code long, n_bytes int, doc_id {kind}, anchors array<struct<hash:long,place:long,first:long,end:long>>")
    return each.groupBy("code", "n_bytes").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("anchors").alias("anchors"))


def contexts(suspects: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """``hash``, ``context`` (MD5 of its bytes) and either its bytes and anchor offset or where it is."""
    kinds = "hash long, context binary, bytes binary, offset int" if with_bytes else "context binary, code long, n_bytes int, first long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                code, n_bytes, text = batch.column(0)[r], batch.column(1)[r], batch.column(2)[r].as_py()
                own = batch.column(3).slice(r, 1).flatten()
                hashes, places, first, end = (own.field(k) for k in range(4))
                parts = [text[a : b - 1 + length] for a, b in zip(first.to_pylist(), end.to_pylist())]
                digests = pa.array([hashlib.md5(p).digest() for p in parts], pa.binary())
                if with_bytes:
                    offset = pa.array((places.to_numpy() - first.to_numpy()).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([hashes, digests, pa.array(parts, pa.binary()), offset], ["hash", "context", "bytes", "offset"])
                else:
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([digests, pa.repeat(code, n), pa.repeat(n_bytes, n), first], ["context", "code", "n_bytes", "first"])

    return suspects.select("code", "n_bytes", "text", "anchors").mapInArrow(run, kinds)


def sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """``context`` and its repeated ranges of windows, for whole groups of equal ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(group: list[tuple]) -> list[tuple[bytes, int, int]]:
            wanted = [n == 1 for _, _, _, n in group]
            found = repeated_windows([g[1] for g in group], [g[2] for g in group], wanted, length)
            return [(g[0], a, b) for g, ranges in zip(group, found) for a, b in ranges]

        held, group = None, []
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for h, context, raw, offset, n in zip(*columns):
                if h != held:
                    out.extend(solved(group))
                    held, group = h, []
                group.append((context, raw, offset, n))
            yield as_ranges(out)
        yield as_ranges(solved(group))

    ordered = rows.select("hash", "context", "bytes", "offset", "n").repartition("hash").sortWithinPartitions("hash")
    return ordered.mapInArrow(run, "context binary, a int, b int")


def as_ranges(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["context", "a", "b"])


def in_blocks(rows: DataFrame, length: int, block: int) -> DataFrame:
    """Contexts cut into the windows whose distance before the anchor is in the same run of ``block``.

    What all windows of a run share, for any context, is part of the new ``hash``: contexts that
    differ there have no window of that run in common. ``parent`` and ``shift`` say where a piece is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
        for batch in batches:
            out = []
            for h, parent, raw, offset, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                last = len(raw) - length
                for j in range((offset - last) // block, offset // block + 1):
                    near, far = j * block, (j + 1) * block - 1
                    a, b = max(offset - far, 0), min(offset - near, last)
                    shared = raw[offset - near : max(offset - far + length, offset - near)]
                    place = f"{h} {block} {j} ".encode()
                    key = int.from_bytes(hashlib.md5(place + shared).digest()[:8], "little", signed=True)
                    piece = raw[a : b + length]
                    out.append((parent, a, n, key, hashlib.md5(place + piece).digest(), piece, offset - a))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["parent", "shift", "n", "hash", "context", "bytes", "offset"])

    kinds = "parent binary, shift int, n long, hash long, context binary, bytes binary, offset int"
    return rows.select("hash", "context", "bytes", "offset", "n").mapInArrow(run, kinds)


def resolved(pooled: DataFrame, length: int, blocks: tuple[int, ...]) -> DataFrame:
    """Ranges of repeated windows (``context, a, b``) for different contexts with their number ``n``.

    Groups of at most ``GROUP_CONTEXTS`` are sorted. Larger ones are cut into ever shorter runs of
    windows, whose equal pieces are combined again; a run of one window is only counted.
    """
    groups = materialize(pooled.groupBy("hash").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1"), "groups")
    open_ = pooled.join(groups.select("hash", "m"), "hash")
    whole = pooled.where("n > 1").select("context", F.lit(0).alias("a"), (F.octet_length("bytes") - length).alias("b"))
    ranges = whole.unionByName(sorted_groups(open_.where(F.col("m") <= GROUP_CONTEXTS), length))
    if not blocks or groups.where(F.col("m") > GROUP_CONTEXTS).isEmpty():
        return ranges
    pieces = materialize(in_blocks(open_.where(F.col("m") > GROUP_CONTEXTS), length, blocks[0]), "pieces")
    inner = pieces.groupBy("hash", "context").agg(F.sum("n").alias("n"), F.any_value("bytes").alias("bytes"), F.any_value("offset").alias("offset"))
    found = resolved(materialize(inner, "contexts"), length, blocks[1:])
    placed = found.join(pieces.where("n = 1").select("parent", "shift", "context"), "context")
    placed = placed.select(F.col("parent").alias("context"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
    return ranges.unionByName(placed)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Texts with copies (``code, n_bytes``), removed whole; other texts with their spans and bytes.

    The second table has ``code, n_bytes, text`` (bytes) and ``spans``, ``(a, b)`` in bytes that may
    overlap, for texts that have any. ``docs`` has ``doc_id`` and ``text``.
    """
    texts = materialize(text_anchors(docs, length, gram), "text-anchors")
    copied = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("code", "n_bytes")

    each = texts.select("code", "n_bytes", F.explode("anchors").alias("anchor"))
    twice = each.groupBy(F.col("anchor.hash").alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("hash")
    twice = materialize(twice, "repeated-grams")  # a table of its own, so that the join can split a gram that many texts have
    found = each.join(twice, each["anchor.hash"] == twice["hash"], "left_semi")
    found = found.groupBy("code", "n_bytes").agg(F.collect_list("anchor").alias("anchors"))
    found = found.join(texts.select("code", "n_bytes", "first_id"), ["code", "n_bytes"])
    text = whole_text(F.col("text"))
    keyed = docs.select(*text_key(text), "doc_id", F.encode(text, "UTF-8").alias("text"))
    same = (keyed["code"] == found["code"]) & (keyed["n_bytes"] == found["n_bytes"]) & keyed["doc_id"].eqNullSafe(found["first_id"])
    # Of rows that are equal in id and text each gives its contexts, which are repeated indeed.
    suspects = materialize(keyed.join(found, same).select(keyed["code"], keyed["n_bytes"], "text", "anchors"), "suspects")

    pooled = contexts(suspects, length, True).groupBy("hash", "context")
    pooled = materialize(pooled.agg(F.count("*").alias("n"), F.any_value("bytes").alias("bytes"), F.any_value("offset").alias("offset")), "contexts")
    ranges = resolved(pooled, length, BLOCKS).groupBy("context").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    ranges = materialize(ranges, "ranges")

    members = contexts(suspects, length, False).join(ranges, "context")
    placed = members.select("code", "n_bytes", F.explode("ranges").alias("r"), "first")
    placed = placed.groupBy("code", "n_bytes").agg(
        F.collect_list(F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b") + length).alias("b"))).alias("spans")
    )
    joined = suspects.dropDuplicates(["code", "n_bytes"]).select("code", "n_bytes", "text").join(placed, ["code", "n_bytes"])
    return copied, joined


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending spans with those that touch or overlap made one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[opens], np.concatenate([reach[opens[1:] - 1], reach[-1:]])


def kept_bytes(rows: DataFrame) -> DataFrame:
    """``code, n_bytes, n_removed``, the merged ``spans`` and ``kept``, the bytes outside them."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            for r in range(batch.num_rows):
                text, own = batch.column(2)[r].as_py(), batch.column(3).slice(r, 1).flatten()
                starts, ends = (x.tolist() for x in merged_spans(own.field(0).to_numpy(), own.field(1).to_numpy()))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])))
                removed.append(sum(ends) - sum(starts))
                spans.append([{"a": a, "b": b} for a, b in zip(starts, ends)])
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["code", "n_bytes", "n_removed", "spans", "kept"])

    kinds = "code long, n_bytes int, n_removed long, spans array<struct<a:long,b:long>>, kept binary"
    return rows.select("code", "n_bytes", "text", "spans").mapInArrow(run, kinds)


def removal_report(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; ``with_text`` adds ``text``, what is kept.

    Null is the empty text. A character that is cut reads as U+FFFD in ``text``; the hash is of the bytes. Texts shorter than ``length`` lose nothing; repeated rows are copies of
    each other. An empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    copied, cut = repeated_spans(docs, length)
    nothing = hashlib.sha256(b"").hexdigest()
    left = [F.make_valid_utf8(F.col("kept").cast("string")).alias("kept")] if with_text else []
    some = kept_bytes(cut).select("code", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"), *left)
    gone = copied.select("code", "n_bytes", F.col("n_bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("sha"), *([F.lit("").alias("kept")] if with_text else []))
    some = some.join(copied, ["code", "n_bytes"], "left_anti")
    effects = materialize(some.unionByName(gone), "removals")
    text = whole_text(F.col("text"))
    rows = docs.select("doc_id", *text_key(text), F.sha2(F.encode(text, "UTF-8"), 256).alias("whole"), text.alias("text"))
    return rows.join(effects, ["code", "n_bytes"], "left").select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        *([F.coalesce("kept", "text").alias("text")] if with_text else []),
    )
