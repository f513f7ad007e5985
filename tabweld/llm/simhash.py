"""SimHash near-dedup with pivot distance tables.

1. A text's fingerprint has the bits that are set in over half of the hashes of its word shingles.
2. Pivot table: each distinct fingerprint's Hamming distances to 56 reference fingerprints. The 64
   bits are four blocks of 16; 14 references differ from zero in one block only, in the patterns of
   Walsh functions. Seven distances are packed into one long, a byte each.
3. Candidates: inside a block, the differences between its references' distances depend on that
   block's bits alone. Two fingerprints at most 2 bits apart agree in two of four blocks at least,
   so they share one of six cells, each a pair of blocks with equal distance differences.
4. A pair of a cell is discarded if some coordinate differs by more than ``max_bits`` (the triangle
   inequality, tested on packed bytes); survivors are verified by their own distance.
5. Cells with more than ``CELL_ROWS`` fingerprints are not paired. Their fingerprints meet, exactly
   and in linear time, at the values one bit away from them: two are within 2 bits if and only if
   they share such a value, and a value has 65 neighbours at most.
6. Components come from alternating star contractions, written between rounds.

Equal fingerprints are one node, whatever the number of their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import ship_by_value
from tabweld.session import materialize

BLOCKS, BLOCK_BITS, REFERENCES = 4, 16, 14
CELL_ROWS = 64
SEED = 42

ship_by_value(__name__)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text as a signed 64-bit number; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    parts = zip(*(words[k:] for k in range(shingle)))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, 1 << 16):
        size = min(1 << 16, n - start)
        codes = np.fromiter((digest(join(part), SEED) for part, _ in zip(parts, range(size))), np.dtype("<u8"), size)
        ones += np.unpackbits(codes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``code`` (a hash of the text) and ``fp`` of every document; null is the empty text."""
    text = F.col(f"`{text_column}`").cast("string")
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("code"), F.encode(text, "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = (fingerprint(texts[i].as_py() or b"", shingle) for i in range(len(texts)))
            fps = pa.array(np.fromiter(found, np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "code", "fp"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, code long, fp long")


def references() -> list[list[int]]:
    """For each block, 14 fingerprints: Walsh patterns 1 to 14 over the block's 16 bits."""
    patterns = [sum(1 << i for i in range(BLOCK_BITS) if (i & k).bit_count() % 2) for k in range(1, REFERENCES + 1)]
    return [[p << (BLOCK_BITS * g) for p in patterns] for g in range(BLOCKS)]


def as_long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def packed_distances(fp: Column) -> list[Column]:
    """The pivot table's row: 8 longs of 7 distances each, two for every block."""
    longs = []
    for block in references():
        for half in (block[:7], block[7:]):
            total = F.lit(0).cast("long")
            for lane, ref in enumerate(half):
                distance = F.bit_count(fp.bitwiseXOR(F.lit(as_long(ref)).cast("long"))).cast("long")
                total = total.bitwiseOR(F.shiftleft(distance, 8 * lane))
            longs.append(total)
    return longs


def block_profiles(fp: Column) -> list[Column]:
    """For each block, its references' distances less the first one's: a function of that block alone."""
    out = []
    for block in references():
        distances = [F.bit_count(fp.bitwiseXOR(F.lit(as_long(r)).cast("long"))) for r in block]
        out.append(F.xxhash64(*(d - distances[0] for d in distances[1:])))
    return out


def cells(fp: Column) -> Column:
    """The six cells of a fingerprint: pairs of blocks with their profiles."""
    profiles = block_profiles(fp)
    pairs = [(g, h) for g in range(BLOCKS) for h in range(g + 1, BLOCKS)]
    return F.array(*(F.xxhash64(F.lit(g), F.lit(h), profiles[g], profiles[h]) for g, h in pairs))


def near_coordinates(a: Column, b: Column, most: int) -> Column:
    """Whether all seven packed distances differ by at most ``most`` (0 to 2).

    In each byte 128 + a - b + most keeps its high bit, and only that one of the five high
    bits, exactly if a - b is between -most and 7 - most; the test runs both ways.
    """
    high, add = (sum(x << (8 * lane) for lane in range(7)) for x in (0x80, most))
    mask = sum(0xF8 << (8 * lane) for lane in range(7))

    def one_way(x: Column, y: Column) -> Column:
        return (x.bitwiseOR(F.lit(high)) - y + F.lit(add)).bitwiseAND(F.lit(mask)) == F.lit(high)

    return one_way(a, b) & one_way(b, a)


def links(fps: DataFrame, max_bits: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs ``a > b`` of distinct fingerprints (column ``fp``) within ``max_bits``, enough to connect
    all that are linked: every pair of small cells, a star for each value shared in large ones."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    placed = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    # A table of its own, so that the join can split a cell with very many fingerprints.
    shared = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell-counts")
    members = materialize(placed.join(shared, "cell"), "shared-cells")

    table = packed_distances(F.col("fp"))
    small = members.where(F.col("n") <= cell_rows).select("cell", "fp", *(c.alias(f"p{i}") for i, c in enumerate(table)))
    left, right = small.alias("l"), small.alias("r")
    near = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") > F.col("r.fp"))
    for i in range(len(table)):
        near = near & near_coordinates(F.col(f"l.p{i}"), F.col(f"r.p{i}"), max_bits)
    near = near & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits)
    pairs = left.join(right, near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    crowded = members.where(F.col("n") > cell_rows).select("fp").distinct()
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(as_long(1 << i)).cast("long")) for i in range(64))]
    around = crowded.select("fp", F.explode(F.array(*flips)).alias("value"))
    balls = around.groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("ball")).where(F.size("ball") > 1)
    centre = F.element_at("ball", 1) if max_bits == 2 else F.col("value")
    stars = balls.select(centre.alias("c"), F.explode("ball").alias("x")).where(F.bit_count(F.expr("c ^ x")).between(1, max_bits))
    if max_bits == 1:  # a value links its neighbours to itself, so it must be a fingerprint
        stars = stars.join(crowded.withColumnRenamed("fp", "c"), "c", "left_semi")
    stars = stars.select(F.greatest("c", "x").alias("a"), F.least("c", "x").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for all nodes of ``pairs`` (a > b).

    Large-star and small-star rounds in turn; each is a minimum by node, written and joined back to
    its edges, so a node with very many neighbours is combined before the shuffle and split by the
    join.
    """
    edges = materialize(pairs.select("a", "b"), "links")
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        lowest = materialize(lowest, "lowest")
        large = both.join(lowest, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "lowest")
        small = large.join(lowest, F.col("a") == F.col("u"))
        small = small.select("b", "m").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def with_components(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """Add ``component_id``, the smallest ``doc_id`` reachable, to ``doc_id, code, fp``.

    Rows without an id take part in links; a component has no id only if none of its rows has.
    Texts without words share the fingerprint zero and are linked like any others.
    """
    rows = materialize(rows, "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = materialize(components(links(nodes.select("fp"), max_bits)), "components")
    linked = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = linked.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "code", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, max_bits: int = 2, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns unchanged.

    Of rows that share that id the one whose text has the smallest hash stays, of equal rows any
    one. Components without ids keep the row with the smallest hash.
    """
    rows = with_components(fingerprints(docs, id_column, text_column, shingle), max_bits)
    kept = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own"))
    kept = kept.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")).alias("k")).select("k.doc_id", "k.code")
    kept = materialize(kept.distinct(), "kept-documents")
    code = F.xxhash64(F.col(f"`{text_column}`").cast("string"))
    numbered = docs.select(F.struct("*").alias("row"), F.col(f"`{id_column}`").alias("id"), code.alias("code"))
    chosen = numbered.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (numbered["code"] == kept["code"]), "left_semi")
    one = chosen.dropDuplicates(["id", "code"])
    return one.select(*(F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in docs.columns))
