"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes. Where tokens of both end together, a group ends; within a group all
A tokens are linked with all B tokens. The weight of a pair of ids is the number of documents that
hold it linked.

1. Identity map: for every A id the B id of the same bytes, if there is one, precomputed as an array.
   A group of one A and one B token has the same bytes on both sides. So nearly all groups are
   looked up in this map; their documents are counted in a vector as long as A's vocabulary.
2. Only irregular groups (several tokens on a side, or one that the map does not give) enter the pair
   shuffle. A block of documents writes each distinct irregular group once, and each pair of ids once with the
   number of its documents.
3. Pair weights are sums of these. The weights of a distinct group's links are added up once in the
   whole corpus, and go back to the blocks that hold the group. Weights of identity pairs go back as
   the vector, which is bounded by the vocabulary.

Blocks are bounded in bytes, so that no task holds more than a block and the vocabularies; a document
over that size is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweld.llm.common import ship_by_value
from tabweld.session import materialize

BLOCK_BYTES = 8 << 20
#: Bytes of text that are encoded at once; the encodings take many times that.
CHUNK_BYTES = 1 << 19
#: A task forgets the units it has met when it remembers more than these.
REMEMBERED = 300_000
#: Where byte-level BPE splits a text before it joins tokens. Fixed value.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units begin with white space after something else. Byte-level BPE ends its splits there, looks ahead over
#: white space only, and never back; so it encodes units on their own. SentencePiece does so if a unit begins
#: with a character that its pieces have at their beginning only.
UNIT = r"\s+\S*(?:[^\S%s]\s*\S*)*"

ship_by_value(__name__)


@dataclass(frozen=True)
class Pair:
    """Files of both tokenizers as bytes (they travel with the plan), and the bytes of all their tokens."""

    a_file: bytes
    b_file: bytes
    a_tokens: tuple[bytes, ...]
    b_tokens: tuple[bytes, ...]
    #: White space that can begin a unit; none if A or B cannot encode units on their own.
    cuts: str
    #: Whether A joins tokens in the order of their ids; then tiktoken gives the same ids in less time.
    ranked: bool

    def identity(self) -> np.ndarray:
        """For each A id the B id of the same bytes, -1 without one; pieces come before single bytes."""
        of = {}
        for b, token in enumerate(self.b_tokens):
            if token:
                of[token] = b  # later ids: pieces follow the single bytes
        return np.array([of.get(t, -1) if t else -1 for t in self.a_tokens], np.int64)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_pair(byte_bpe: str, piece_model: str) -> Pair:
    """A from a byte-level BPE (JSON of the tokenizers library), B from a SentencePiece model."""
    import sentencepiece

    with open(byte_bpe, "rb") as f:
        a_file = f.read()
    with open(piece_model, "rb") as f:
        b_file = f.read()
    described = json.loads(a_file)
    vocabulary = described["model"]["vocab"]
    special = {t["id"]: t["content"] for t in described.get("added_tokens", [])}
    letters = byte_alphabet()
    a_tokens = [b""] * (1 + max([*vocabulary.values(), *special]))
    for token, i in vocabulary.items():
        if i not in special:
            a_tokens[i] = bytes(letters[c] for c in token)
    model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    b_tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            b_tokens.append(bytes([int(piece[3:5], 16)]))
        else:
            b_tokens.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    splits = described.get("pre_tokenizer") or {}
    in_a = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space") and not described.get("normalizer")
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in described["model"]["merges"]]
    pieces = [t.decode("utf-8", "replace") for i, t in enumerate(b_tokens) if not model.is_byte(i)]
    cuts = [c for c in " \n\t" if in_a and not any(c in p.lstrip(c) for p in pieces)]
    return Pair(a_file, b_file, tuple(a_tokens), tuple(b_tokens), "".join(cuts) if " " in cuts else "", in_a and made == sorted(made))


class Encoders:
    """Both tokenizers, opened once in a task."""

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = pair.ranked and {bytes([b]) for b in range(256)} <= set(pair.a_tokens)  # A loses nothing then
        if pair.ranked:
            ranks = {t: i for i, t in enumerate(pair.a_tokens) if t}
            one = tiktoken.Encoding("a", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.in_a = lambda units: map(one, units)
        else:
            library = Tokenizer.from_buffer(pair.a_file)
            library.encode_special_tokens = True  # their strings in a text are plain text
            self.in_a = lambda units: (e.ids for e in library.encode_batch_fast(units, add_special_tokens=False))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b_file)
        self.a_tokens, self.b_tokens, self.cuts = pair.a_tokens, pair.b_tokens, pair.cuts
        self.find = regex.compile(UNIT % pair.cuts).findall
        self.prefix = [self.b.piece_to_id("\u2581")]

    def units(self, text: str) -> list[str]:
        """Parts of a space and the text that both tokenizers encode on their own."""
        return self.find(" " + text) if self.cuts else [" " + text]

    def encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of each unit; None where the tokens' bytes are not those of the unit."""
        in_b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for unit, a, b in zip(units, self.in_a(units), in_b):
            if unit == " ":  # B puts no space before nothing
                b = self.prefix
            elif unit[0] != " ":  # B put its own space before
                b = b[1:] if b[:1] == self.prefix else []
            whole = unit.encode("utf-8", "replace")
            same = b"".join(map(self.b_tokens.__getitem__, b)) == whole and (self.exact or b"".join(map(self.a_tokens.__getitem__, a)) == whole)
            yield (a, b) if same else None


def groups_in(a: list[int], b: list[int], a_bytes: list[int], b_bytes: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of every group of two encodings of the same bytes."""
    a_end = b_end = i = j = low = below = 0
    while i < len(a):
        a_end += a_bytes[a[i]]
        i += 1
        while b_end < a_end:
            b_end += b_bytes[b[j]]
            j += 1
        if a_end == b_end:
            yield a[low:i], b[below:j]
            low, below = i, j


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(len(shift)) + shift


@dataclass
class Held:
    """A distinct irregular group: its ids with their times, and its pairs of ids (a * width + b)."""

    key: bytes
    a: np.ndarray
    a_times: np.ndarray
    b: np.ndarray
    b_times: np.ndarray
    pairs: np.ndarray


class Lists:
    """Short lists of whole numbers, one after the other."""

    def __init__(self) -> None:
        self.values, self.ends = array("i"), array("q", [0])

    def append(self, values: list[int]) -> None:
        self.values.extend(values)
        self.ends.append(len(self.values))

    def counted(self, which: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of the chosen lists, each list so many times, and how often each occurs."""
        ends, values = np.frombuffer(self.ends, np.int64), np.frombuffer(self.values, np.int32)
        sizes = ends[which + 1] - ends[which]
        found, at = np.unique(values[ranges(ends[which], sizes)], return_inverse=True)
        return found, np.bincount(at, np.repeat(times, sizes), len(found)).astype(np.int32)


class Units:
    """What a task remembers: the units it has met, their identity tokens and their irregular groups."""

    def __init__(self, encoders: Encoders, identity: np.ndarray):
        self.encoders, self.identity, self.same = encoders, identity, identity.tolist()
        self.sizes = [list(map(len, tokens)) for tokens in (encoders.a_tokens, encoders.b_tokens)]
        self.width = len(encoders.b_tokens)
        self.plain_text = [f"{a}|{b}" for a, b in enumerate(self.same)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.spelled: list[str | None] = []
        self.counts, self.plain, self.odd = array("q"), Lists(), Lists()
        self.codes: dict[tuple, int] = {}
        self.groups: list[Held] = []
        self.odd_text: list[str] = []

    def code_of(self, a: list[int], b: list[int]) -> int:
        key = (tuple(a), tuple(b))
        code = self.codes.get(key)
        if code is None:
            code = self.codes[key] = len(self.groups)
            (x, m), (y, n) = (np.unique(np.array(ids, np.int32), return_counts=True) for ids in key)
            pairs = (x.astype(np.int64)[:, None] * self.width + y).ravel()
            self.odd_text.append("|".join(",".join(map(str, ids)) for ids in key))
            self.groups.append(Held(hashlib.blake2b(repr(key).encode(), digest_size=16).digest(), x, m, y, n, pairs))
        return code

    def learn(self, units: list[str]) -> None:
        for unit, ids in zip(units, self.encoders.encode(units)):
            self.known[unit] = len(self.spelled)
            plain, odd, spelled, links = [], [], [], 0
            a, b = ids or ((), ())
            for x, y in groups_in(a, b, *self.sizes):
                if len(x) == len(y) == 1 and self.same[x[0]] == y[0]:
                    plain.append(x[0])
                    spelled.append(self.plain_text[x[0]])
                    links += 1
                else:
                    code = self.code_of(x, y)
                    odd.append(code)
                    spelled.append(self.odd_text[code])
                    links += len(x) * len(y)
            self.plain.append(plain)
            self.odd.append(odd)
            self.counts.extend((len(a), len(b), len(spelled), links))
            self.spelled.append(";".join(spelled) if ids else None)

    def numbered(self, texts: list[str]) -> Iterator[list[int]]:
        """The units of each text, by number."""
        split = [self.encoders.units(t) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.known)))
        for units in split:
            yield list(map(self.known.__getitem__, units))


class Block:
    """Documents of a block, the irregular groups in them, and the pairs that each document holds."""

    def __init__(self, units: Units):
        self.units, self.bytes = units, 0
        self.docs: list[dict] = []
        self.codes: list[np.ndarray] = []
        self.held: list[np.ndarray] = []

    def add(self, doc_id: object, numbers: list[int], seen: np.ndarray) -> None:
        """Take a document in; ``seen`` counts documents by the A ids that they hold linked to the identical token."""
        units = self.units
        spelled = list(map(units.spelled.__getitem__, numbers))
        if None in spelled:
            numbers, spelled = [], []
        which, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        own, own_times = units.plain.counted(which, times)
        codes, code_times = units.odd.counted(which, times)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(units.groups[c].pairs for c in codes.tolist())]))
        same = units.identity[pairs // units.width] == pairs % units.width
        seen[np.union1d(own, pairs[same] // units.width)] += 1
        self.held.append(pairs[~same])
        self.codes.append(codes)
        counts = np.frombuffer(units.counts, np.int64).reshape(-1, 4)
        self.docs.append(
            {
                "doc_id": doc_id,
                "sizes": (times @ counts[which]).tolist(),
                "a": own.tobytes(),
                "a_times": own_times.tobytes(),
                "codes": codes.tobytes(),
                "code_times": code_times.tobytes(),
                "groups_sha256": hashlib.sha256(";".join(spelled).encode()).hexdigest() if spelled else "",
            }
        )


def first_pass(docs: DataFrame, pair: Pair, id_column: str, text_column: str, block_bytes: int) -> DataFrame:
    """Rows of documents (``sizes`` given), of distinct irregular groups (``code`` given) and of pairs (``docs`` given)."""
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").cast("binary").alias("text"))
    ints = T.ArrayType(T.IntegerType())
    fields = {"block": T.LongType(), "doc_id": slim.schema["doc_id"].dataType, "sizes": T.ArrayType(T.LongType())}
    fields |= dict.fromkeys(("a", "a_times", "codes", "code_times"), T.BinaryType()) | {"groups_sha256": T.StringType()}
    fields |= {"code": T.IntegerType(), "key": T.BinaryType()} | dict.fromkeys(("group_a", "times_a", "group_b", "times_b"), ints)
    fields |= {"a_id": T.IntegerType(), "b_id": T.IntegerType(), "docs": T.LongType(), "same": T.BooleanType()}
    sent = slim.sparkSession.sparkContext.broadcast(pair)  # as large as the tokenizers' files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity = sent.value.identity()
        units = Units(Encoders(sent.value), identity)
        seen = np.zeros(len(identity), np.int64)
        number = TaskContext.get().partitionId() << 33
        block, kind = Block(units), None

        def rows(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            given = [columns.get(c, pa.nulls(n, t)) for c, t in kind.items()]
            return pa.RecordBatch.from_arrays(given, list(kind))

        def ended() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(block.docs), 1024):
                part = block.docs[at : at + 1024]
                given = {c: pa.array([d[c] for d in part], kind[c]) for c in part[0]}
                yield rows(block=pa.array([number] * len(part), pa.int64()), **given)
            used = np.unique(np.concatenate(block.codes))
            for at in range(0, len(used), 1 << 14):
                codes = used[at : at + (1 << 14)]
                part = [units.groups[c] for c in codes.tolist()]
                lists = {c: pa.array([getattr(g, f) for g in part], pa.list_(pa.int32())) for c, f in (("group_a", "a"), ("times_a", "a_times"), ("group_b", "b"), ("times_b", "b_times"))}
                yield rows(block=pa.array([number] * len(part), pa.int64()), code=pa.array(codes), key=pa.array([g.key for g in part], pa.binary()), **lists)
            pairs, counts = np.unique(np.concatenate(block.held), return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                ids = {"a_id": pa.array(part // units.width, pa.int32()), "b_id": pa.array(part % units.width, pa.int32())}
                yield rows(**ids, docs=pa.array(counts[at : at + (1 << 16)], pa.int64()), same=pa.array(np.zeros(len(part), bool)))

        def cut(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
            start = size = 0
            for i, text in enumerate(texts):
                if size and size + len(text) > CHUNK_BYTES:
                    yield ids[start:i], texts[start:i]
                    start, size = i, 0
                size += len(text) + 1
            yield ids[start:], texts[start:]

        for batch in batches:
            if kind is None:
                plain = pa.list_(pa.int32())
                kind = {"block": pa.int64(), "doc_id": batch.column(0).type, "sizes": pa.list_(pa.int64())}
                kind |= dict.fromkeys(("a", "a_times", "codes", "code_times"), pa.binary()) | {"groups_sha256": pa.string()}
                kind |= {"code": pa.int32(), "key": pa.binary()} | dict.fromkeys(("group_a", "times_a", "group_b", "times_b"), plain)
                kind |= {"a_id": pa.int32(), "b_id": pa.int32(), "docs": pa.int64(), "same": pa.bool_()}
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t.as_py() or b"" for t in part.column(1)]
                for ids, some in cut(part.column(0).to_pylist(), texts):
                    if block.docs and block.bytes + sum(map(len, some)) > block_bytes:
                        yield from ended()
                        number, block = number + 1, Block(units)
                        if len(units.known) > REMEMBERED:
                            units.forget()
                    for doc_id, numbers in zip(ids, units.numbered([t.decode("utf-8", "replace") for t in some])):
                        block.add(doc_id, numbers, seen)
                    block.bytes += sum(len(t) + 64 for t in some)
        if block.docs:
            yield from ended()
            a = np.flatnonzero(seen)
            yield rows(a_id=pa.array(a, pa.int32()), b_id=pa.array(identity[a], pa.int32()), docs=pa.array(seen[a], pa.int64()), same=pa.array(np.ones(len(a), bool)))

    schema = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    return materialize(slim.mapInArrow(run, schema), "token-groups")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a_id``, ``b_id``, ``docs`` (documents that hold the pair linked) and ``same`` (the identity map's pair)."""
    return rows.where("docs is not null").groupBy("a_id", "b_id", "same").agg(F.sum("docs").alias("docs"))


def aligned(docs: DataFrame, pair: Pair, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The alignment of both tokenizers over all documents: its pairs, and each document's part in it.

    Pairs: ``a_id``, ``b_id``, ``docs``, ``same``. Documents: ``doc_id``, ``n_a`` and ``n_b`` tokens, ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair is the most frequent one of its A id, ties included),
    ``count_sum`` (frequencies of all links) and ``groups_sha256`` (a hash of all groups; empty without tokens).

    A is encoded from a space and the text, B from the text. Null and empty texts, and those whose
    tokens do not give back the text's bytes in A or B (such as texts with U+2581), have no tokens. Every
    row is a document, repeated and null ids too; an empty table gives empty results. Other columns are ignored.
    """
    rows = first_pass(docs, pair, id_column, text_column, block_bytes)
    pairs = materialize(pair_counts(rows), "pair-counts")
    best = materialize(pairs.groupBy("a_id").agg(F.max("docs").alias("best")), "best-counts")

    groups = rows.where("code is not null").select("block", "code", "key", "group_a", "times_a", "group_b", "times_b")
    once = groups.groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("group_a", "times_a", "group_b", "times_b")))
    sides = once.select("key", F.explode(F.arrays_zip("group_a", "times_a")).alias("x"), "group_b", "times_b")
    linked = sides.select("key", "x", F.explode(F.arrays_zip("group_b", "times_b")).alias("y"))
    linked = linked.select("key", F.col("x.group_a").alias("a_id"), F.col("y.group_b").alias("b_id"), (F.col("x.times_a").cast("long") * F.col("y.times_b")).alias("times"))
    weighed = linked.join(pairs.select("a_id", "b_id", "docs"), ["a_id", "b_id"]).join(best, "a_id")
    sums = weighed.groupBy("key").agg(F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    back = groups.select("block", "code", "key").join(materialize(sums, "group-sums"), "key").select("block", "code", "count_sum", "n_best")
    back = materialize(back, "block-sums")

    # One line for each A id with an identical B id: bounded by A's vocabulary.
    vector = pairs.where("same").join(best, "a_id").select("a_id", "docs", "best").toArrow()
    weight, is_best = np.zeros(len(pair.a_tokens), np.int64), np.zeros(len(pair.a_tokens), np.int64)
    at = vector["a_id"].to_numpy()
    weight[at] = vector["docs"].to_numpy()
    is_best[at] = vector["docs"].to_numpy() == vector["best"].to_numpy()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["code"].to_numpy())
        code, total, chosen = (right[c].to_numpy()[order] for c in ("code", "count_sum", "n_best"))
        count_sum, n_best = [], []
        for a, a_times, codes, code_times in zip(*(left[c].to_pylist() for c in ("a", "a_times", "codes", "code_times"))):
            a, a_times, codes, code_times = (np.frombuffer(x, np.int32) for x in (a, a_times, codes, code_times))
            codes = np.searchsorted(code, codes)
            count_sum.append(int(weight[a] @ a_times) + int(total[codes] @ code_times))
            n_best.append(int(is_best[a] @ a_times) + int(chosen[codes] @ code_times))
        sizes = left["sizes"].combine_chunks().flatten().to_numpy().reshape(-1, 4)
        numbers = [pa.array(sizes[:, k]) for k in range(4)] + [pa.array(x, pa.int64()) for x in (n_best, count_sum)]
        return pa.table([left["doc_id"], *numbers, left["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    slim = rows.where("sizes is not null").select("block", "doc_id", "sizes", "a", "a_times", "codes", "code_times", "groups_sha256")
    result = slim.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        add_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return pairs, result


def groups_of(docs: DataFrame, pair: Pair, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``groups`` (``a`` and ``b``: arrays of ids) of every document, under the rules of ``aligned``."""
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").cast("binary").alias("text"))
    sent = slim.sparkSession.sparkContext.broadcast(pair)
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(sent.value)
        sizes = [list(map(len, tokens)) for tokens in (encoders.a_tokens, encoders.b_tokens)]
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(1)[i].as_py() or b"").decode("utf-8", "replace")
                units = encoders.units(text) if text else []
                ids = list(encoders.encode(units)) if units else []
                cut = [] if None in ids else [{"a": x, "b": y} for a, b in ids for x, y in groups_in(a, b, *sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([cut], kind)], ["doc_id", "groups"])

    doc_id = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {doc_id}, groups array<struct<a: array<int>, b: array<int>>>")
