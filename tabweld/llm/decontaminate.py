"""Benchmark decontamination with a distributed positional inverted index.

1. Index. Documents are packed into segments of about ``SEGMENT_BYTES``. A segment has a row for each
   of its terms with the ascending positions of that term, and a row for each of its documents. One
   position is left free between documents, so that no phrase runs from one into the next. A document
   longer than a segment is divided into parts that own their words and see ``reach`` more on either
   side; so each occurrence lies whole in a part, and each word is counted by the part that owns it.
2. Plan. The terms of all phrases are counted over the index. Phrases with a term that no document
   has are dropped; the others get their terms in rising order of frequency.
3. Search. Phrases meet the segments that hold their rarest term, and these segments' lists of phrase
   terms. Within a segment, the rarest list less that term's offset is the list of possible starts;
   every further list, less its offset, is intersected with it by binary search.
   ``within`` asks for proximity instead: all words of the phrase, in any order, within so many words.

Words are stretches of letters a-z (A-Z lower-cased), digits and non-ASCII characters. No list leaves
its segment, so memory in a task is bounded by a segment and the phrases that may occur in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.llm.common import ship_by_value
from tabweld.session import materialize

SEGMENT_BYTES = 4 << 20
#: Phrases with one rarest term travel together, about so many to a row.
BUNDLE = 64
#: A character class of what words are made of, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)

ship_by_value(__name__)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = IN_WORD[np.frombuffer(text, np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def terms_of(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word's term, and where each word starts."""
    starts, ends = word_bounds(text)
    low = LOWER[np.frombuffer(text, np.uint8)]
    data = low[IN_WORD[low]]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), starts


def parts_of(text: bytes, segment_bytes: int, reach: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Parts of a document: their text, the words they own (from, to) in it, and the number of its first word."""
    if len(text) <= segment_bytes:
        yield text, 0, -1, 0
        return
    starts, ends = word_bounds(text)
    cuts = np.searchsorted(starts, np.arange(segment_bytes, len(text), segment_bytes)).tolist()
    bounds = sorted({0, len(starts), *cuts})
    for low, high in zip(bounds, bounds[1:]):
        first, last = max(0, low - reach), min(len(starts), high + reach)
        yield text[starts[first] : ends[last - 1]], low - first, high - first, first
    if len(starts) == 0:
        yield b"", 0, -1, 0


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = 9, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The positional index of all documents, as a written table; serves phrases of up to ``reach + 1`` words.

    Term rows: ``segment``, ``term``, ``n``, ``positions``. Document rows (``term`` null): ``segment``,
    ``row`` (unique for each input row), ``doc_id``, ``first`` (position of the first word), ``own_from``,
    ``own_to`` (the words that are counted here), ``offset`` (number of the first word in the document).
    A null text has no words; null and repeated ids are rows like any other. Other columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("term", T.BinaryType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", kind),
            *(T.StructField(c, T.LongType()) for c in ("first", "own_from", "own_to", "offset")),
        ]
    )

    def segment_rows(segment: int, parts: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        terms, codes, starts = terms_of(b" ".join(p[2] for p in parts) + b" ")
        begins = np.cumsum([0, *(len(p[2]) + 1 for p in parts)])
        word = np.searchsorted(starts, begins)
        n_words, first = np.diff(word), word[:-1] + np.arange(len(parts))
        positions = np.arange(len(codes)) + np.repeat(np.arange(len(parts)), n_words)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(terms))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(positions[order], pa.int32()))
        n, m = len(terms), len(parts)
        none = [pa.nulls(n, t) for t in (pa.int64(), id_type, *[pa.int64()] * 4)]
        own_to = [n_words[i] if p[4] < 0 else p[4] for i, p in enumerate(parts)]
        rows = {
            "row": pa.array([p[0] for p in parts], pa.int64()),
            "doc_id": pa.array([p[1] for p in parts], id_type),
            "first": pa.array(first, pa.int64()),
            "own_from": pa.array([p[3] for p in parts], pa.int64()),
            "own_to": pa.array(own_to, pa.int64()),
            "offset": pa.array([p[5] for p in parts], pa.int64()),
        }
        names = schema.names
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, segment), pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, lists.type), *rows.values()], names)
        for at in range(0, n, 1 << 14):
            size = min(1 << 14, n - at)
            cut = [terms.slice(at, size), pa.array(counts[at : at + size], pa.int32()), lists.slice(at, size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, segment), pa.int64()), *cut, *(x.slice(at, size) for x in none)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row = segment = base
        waiting, size, id_type = [], 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part, low, high, offset in parts_of(text.as_py() or b"", segment_bytes, reach):
                    if waiting and size + len(part) > segment_bytes:
                        yield from segment_rows(segment, waiting, id_type)
                        segment, waiting, size = segment + 1, [], 0
                    waiting.append((row, doc_id, part, low, high, offset))
                    size += len(part) + 64
                row += 1
        if waiting:
            yield from segment_rows(segment, waiting, id_type)

    return materialize(slim.mapInArrow(run, schema), "positional-index")


def windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = 10) -> DataFrame:
    """``words`` (binary) of every distinct window of ``size`` words, with the ``item_ids`` that have it.

    An item with fewer words is one window, one without words is none. A null id reads ``null``.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.col(f"`{text_column}`").cast("string"), letters, letters.lower())
    split = items.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null")).alias("item"), F.expr("0").alias("zero"), F.regexp_extract_all(low, F.lit(f"({WORD})")).alias("all"))
    split = split.where(F.size("all") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - size + 1))
    cut = split.select("item", F.explode(F.transform(at, lambda i: F.slice("all", i, size))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("item_ids")).select(F.col("words").cast("array<binary>").alias("words"), "item_ids")


def plan(idx: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases whose words all occur in the index: ``steps`` (term, offset) from the rarest on, ``item_ids``."""
    needed = materialize(phrases.select(F.explode("words").alias("term")).distinct(), "phrase-terms")
    counted = idx.where("term is not null").select("term", "n").join(needed, "term", "left_semi")
    counts = materialize(counted.groupBy("term").agg(F.sum("n").alias("total")), "term-counts")
    placed = phrases.select("words", "item_ids", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    steps = F.sort_array(F.collect_list(F.struct("total", "term", "offset")))
    known = placed.groupBy("words").agg(steps.alias("steps"), F.any_value("item_ids").alias("item_ids"))
    return known.where(F.size("steps") == F.size("words")).select(F.expr("transform(steps, s -> struct(s.term, s.offset))").alias("steps"), "item_ids")


def phrase_starts(steps: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Positions where a phrase starts: offset-adjusted lists, intersected from the rarest term on."""
    found = steps[0][0] - steps[0][1]
    for listed, offset in steps[1:]:
        at = np.searchsorted(listed, found + offset)
        at[at == len(listed)] = 0
        found = found[listed[at] == found + offset]
        if not len(found):
            break
    return found


def near_spans(lists: dict[int, np.ndarray], need: Counter, rarest: int, within: int, firsts: np.ndarray) -> list[tuple[int, int]]:
    """Shortest stretches (first, last position) of at most ``within`` words with all words of a phrase, in any order."""
    places = lists[rarest]
    for term in need:
        low, high = (np.searchsorted(lists[term], places + side) for side in (1 - within, within))
        places = places[high - low >= need[term]]
    spans = set()
    for p in places.tolist():
        around = []
        for term in need:
            low, high = np.searchsorted(lists[term], [p - within + 1, p + within])
            around += [(at, term) for at in lists[term][low:high].tolist()]
        around.sort()
        have, left = Counter(), 0
        for at, term in around:
            have[term] += 1
            while have[around[left][1]] > need[around[left][1]]:
                have[around[left][1]] -= 1
                left += 1
            start = around[left][0]
            if at - start < within and all(have[t] >= k for t, k in need.items()):
                if np.searchsorted(firsts, start, "right") == np.searchsorted(firsts, at, "right"):
                    spans.add((start, at))
    return sorted(s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans))


def hits(idx: DataFrame, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """``row``, ``n_hit``, ``item_ids`` and ``spans`` (hit words of the document, from and to) of every part with a hit.

    ``within`` None: phrases as they stand. Otherwise proximity matches.
    """
    planned = plan(idx, phrases).select(F.col("steps")[0]["term"].alias("rare"), F.struct("steps", "item_ids").alias("phrase"))
    planned = materialize(planned, "phrase-plans")
    sizes = planned.groupBy("rare").agg(F.count("*").alias("n"))
    salted = planned.join(sizes, "rare").withColumn("salt", F.pmod(F.xxhash64("phrase.steps"), F.ceil(F.col("n") / BUNDLE)))
    bundles = salted.groupBy("rare", "salt").agg(F.collect_list("phrase").alias("phrases")).select("rare", "phrases")
    # Tables of their own, so that Spark knows how small they are before it moves the index.
    rare = materialize(planned.select("rare").distinct(), "rare-terms")
    known = materialize(planned.select(F.explode("phrase.steps.term").alias("term")).distinct(), "known-terms")
    terms = idx.where("term is not null")
    places = terms.select("segment", F.col("term").alias("rare")).join(rare, "rare", "left_semi")
    places = materialize(places.join(bundles, "rare").select("segment", "phrases"), "phrase-places")
    asked = materialize(places.select("segment").distinct(), "asked-segments")
    lists = terms.join(known, "term", "left_semi").unionByName(idx.where("term is null")).join(asked, "segment", "left_semi")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        listed, parts = left.filter(pc.is_valid(left["term"])), left.filter(pc.is_null(left["term"]))
        terms, positions = (listed[c].combine_chunks() for c in ("term", "positions"))
        values, bounds = positions.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(listed["n"].to_numpy())])
        first, rows = (parts[c].to_numpy() for c in ("first", "row"))
        order = np.argsort(first)
        first, rows = first[order], rows[order]
        own_from, own_to, offset = (parts[c].to_numpy()[order] for c in ("own_from", "own_to", "offset"))
        phrases = right["phrases"].combine_chunks().flatten()
        steps, item_ids = pc.struct_field(phrases, "steps"), pc.struct_field(phrases, "item_ids")
        flat = steps.flatten()
        codes = pc.index_in(pc.struct_field(flat, "term"), value_set=terms).fill_null(-1).to_numpy()
        shifts = pc.struct_field(flat, "offset").to_numpy()
        ends_at = np.cumsum(pc.list_value_length(steps).to_numpy())
        starts_at = np.concatenate([[0], ends_at[:-1]])
        whole = np.flatnonzero(np.minimum.reduceat(codes, starts_at) >= 0)  # all their terms are in this segment
        marks = np.zeros(int((first + own_to).max()) + 2, np.int32)
        items: dict[int, set] = {}
        for k in whole.tolist():
            used, shift = codes[starts_at[k] : ends_at[k]].tolist(), shifts[starts_at[k] : ends_at[k]].tolist()
            lists = {c: values[bounds[c] : bounds[c + 1]] for c in used}
            if within is None:
                starts = phrase_starts([(lists[c], by) for c, by in zip(used, shift)])
                ends = starts + len(used)
            else:
                spans = np.array(near_spans(lists, Counter(used), used[0], within, first), np.int64).reshape(-1, 2)
                starts, ends = spans[:, 0], spans[:, 1] + 1
            if len(starts):
                if ends.max() >= len(marks):
                    marks = np.concatenate([marks, np.zeros(int(ends.max()), np.int32)])
                np.add.at(marks, starts, 1)
                np.add.at(marks, ends, -1)
                for doc in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                    items.setdefault(doc, set()).update(item_ids[k].as_py())
        hit = np.cumsum(marks) > 0
        out: dict[str, list] = {"row": [], "n_hit": [], "item_ids": [], "spans": []}
        for doc, ids in sorted(items.items()):
            low = int(first[doc] + own_from[doc])
            own = np.concatenate([[0], hit[low : int(first[doc] + own_to[doc])].astype(np.int8), [0]])
            edges, shift = np.diff(own), int(offset[doc] + own_from[doc])
            out["row"].append(int(rows[doc]))
            out["n_hit"].append(int(own.sum()))
            out["item_ids"].append(sorted(ids))
            out["spans"].append([{"from": a + shift, "to": b + shift} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())])
        kind = pa.schema([("row", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])
        return pa.Table.from_pydict(out, schema=kind)

    grouped = lists.groupBy("segment").cogroup(places.groupBy("segment"))
    return grouped.applyInArrow(search, "row long, n_hit long, item_ids array<string>, spans array<struct<from: long, to: long>>")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    within: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``item_ids`` and ``spans`` of every document.

    A word is hit if it lies in an occurrence of a window of ``size`` words of an item (or of a shorter
    item as a whole); with ``within``, in a stretch of so many words that has all of a window's words.
    Null and empty texts have no words and no hits. Every row of ``docs`` gives a row, repeated ids and
    null ids too; repeated items count once, by id. Without items, or without documents, nothing is
    hit. Other columns of either table are ignored. Spans of a document longer than a segment are cut
    where it is divided.
    """
    reach = max(size, within or 0) - 1
    idx = index(docs, id_column, text_column, reach, segment_bytes)
    found = hits(idx, materialize(windows(items, item_column, item_text_column, size), "phrases"), within)
    parts = idx.where("term is null").select("row", "doc_id", (F.col("own_to") - F.col("own_from")).alias("n_words"))
    both = parts.unionByName(found, allowMissingColumns=True)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    rows = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_words").alias("n_words"),
        F.coalesce(F.sum("n_hit"), F.lit(0)).alias("n_hit"),
        names.alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return rows.drop("row")


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: words, hit words, items, their hash, and whether anything is hit."""
    return contaminated(docs, items, size).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
