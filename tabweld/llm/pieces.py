"""SentencePiece encoding and decoding by suffix-array matching.

For each batch of texts the different words that were not met before are joined into one text. Its
suffixes are sorted, every piece of the vocabulary finds the range of suffixes that start with it
by binary search, and the occurrences become edges from a place to the place after the piece.
Each edge is relaxed once, by rising place; for ``bpe`` models the edges that lie equally far
from their words' beginnings are relaxed together:

* ``unigram`` models keep for each place the best sum of scores (ties: the edge found first, from
  the earliest start);
* ``bpe`` models keep the last piece of the encoding of the text up to that place. A piece extends
  it if and only if the two pieces alone are encoded as these two; exactly one piece does so for
  each place, so the result is that of merging the best pair again and again.

Words are the text between spaces with the spaces before them; no piece has a space after another
character, so their encodings do not depend on each other. Nor do those of letters and of marks
beside them, where no piece holds both next to each other: these are words of their own. A character without a piece becomes its
UTF-8 bytes' pieces, or the unknown piece if the model has none. As in the reference library's
identity models, a space is put before a text that is not empty, and U+2581 stands for a space, so
texts with that character come back with a space instead; all others come back unchanged.

Batches are cut at ``BATCH_CHARS``, the new words of a batch at ``LEARN_CHARS``, and the memory of words
met before at ``MOST_WORDS``, so memory does not grow with the input; only one text longer than that is held whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweld.llm.common import ship_by_value

SPACE = "\u2581"
BATCH_CHARS = 3_000_000
LEARN_CHARS = 500_000
MOST_WORDS = 400_000
#: Edges so far from their word's beginning, which only long words have, are relaxed one by one.
LEVELS = 64
PAIR_BITS = 18
START, NONE = -1, -2
GAP = b"\xfe"

ship_by_value(__name__)


@dataclass
class Vocabulary:
    """Pieces (U+2581 as a space) with scores; ids of the 256 byte pieces, if any, and of the unknown piece."""

    pieces: list[str]
    scores: list[float]
    kind: str = "bpe"
    bytes_: list[int] = field(default_factory=list)
    unknown: int = 0
    control: frozenset[int] = frozenset()

    def spellings(self) -> list[tuple[int, str]]:
        """Ids and strings of the pieces that are text."""
        skip = {self.unknown, *self.bytes_, *self.control}
        return [(i, p) for i, p in enumerate(self.pieces) if i not in skip and p]


def read_vocabulary(path: str, kind: str = "bpe") -> Vocabulary:
    """The vocabulary of a model file; only the driver reads it, tasks get the pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return Vocabulary(
        [model.id_to_piece(i).replace(SPACE, " ") for i in ids],
        [model.get_score(i) for i in ids],
        kind,
        [i for i in ids if model.is_byte(i)],
        model.unk_id(),
        frozenset(i for i in ids if model.is_control(i) or model.is_unused(i)),
    )


def suffix_order(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's characters, sorted by the ``width`` bytes from there, and those bytes."""
    padded = np.frombuffer(text + bytes(width), np.uint8)
    starts = np.flatnonzero((padded[: len(text)] & 0xC0) != 0x80)
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    keys = np.ascontiguousarray(keys).view(f"S{width}").ravel()
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


def marks_apart(pieces: list[str], alone: str) -> str:
    """Characters that no piece has next to another character than these and spaces.

    Characters that are neighbours in a piece are linked; the marks are the groups with an ASCII
    character, but for the largest group, which is that of the letters.
    """
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for p in pieces:
        for a, b in zip(p, p[1:]):
            if a != " " and b != " ":
                root[find(a)] = find(b)
    groups: dict[str, list[str]] = {}
    for c in list(root):
        groups.setdefault(find(c), []).append(c)
    ordered = sorted(groups.values(), key=len)[:-1]
    return "".join(c for g in ordered if any(x < "\x80" for x in g) for c in sorted(g) if c not in alone)


class Encoder:
    """Encodes words; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        spelled = vocabulary.spellings()
        self.ids = np.array([i for i, _ in spelled], np.int64)
        raw = [p.encode("utf-8") for _, p in spelled]
        self.lengths = np.array([len(p) for p in raw], np.int64)
        self.width = max([8, *map(len, raw)])
        order = sorted(range(len(raw)), key=raw.__getitem__)
        self.ids, self.lengths = self.ids[order], self.lengths[order]
        self.low = np.array([raw[i] for i in order], f"S{self.width}")
        # No UTF-8 text has the byte 255: these are above all suffixes that start with the piece.
        self.high = np.array([raw[i].ljust(self.width, b"\xff") for i in order], f"S{self.width}")
        self.by_text = {p: i for i, p in spelled}
        self.unknown_edge = len(vocabulary.pieces)
        self.decoder = Decoder(vocabulary)
        self.byte_ids = np.array(vocabulary.bytes_, np.int64)
        self.spans = np.array([len(r) for r in self.decoder.raw], np.int64)
        self.fits: dict[int, bool] = {}
        self.growths: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        # What ``fits`` says, by a hash of the pair; a later pair of the same hash replaces an earlier one.
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        inside = {c for _, p in spelled if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        marks = re.escape(marks_apart([p for _, p in spelled], alone))
        other = f"[^ {alone}{marks}]"
        runs = f"{other}+|[{marks}]+" if marks else f"{other}+"
        self.words = re.compile(f" +(?:{runs})?|{runs}" + (f"|[{alone}]" if alone else ""))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.begin, self.size, self.comes_back = array("i"), array("q"), array("i"), array("b")

    def split(self, text: str) -> list[str]:
        return self.words.findall(" " + text.replace(SPACE, " ")) if text else []

    def growth(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece arises from its characters by merging the best neighbours (the first of equals) again and
        again: scores of the merges, and the first and the last part before each and at the end; None if it does not."""
        if piece in self.growths:
            return self.growths[piece]
        parts, scores, by_text = list(self.vocabulary.pieces[piece]), self.vocabulary.scores, self.by_text
        merges, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = by_text.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        grown = (merges, firsts, lasts) if len(parts) == 1 and by_text[parts[0]] == piece else None
        self.growths[piece] = grown
        return grown

    def extends(self, last: int, piece: int) -> bool:
        """Whether an encoding that ends in ``last`` goes on with ``piece``: both arise side by side, and
        at no time are the parts that meet between them the best neighbours."""
        if piece == self.unknown_edge:
            return True
        key = last * (self.unknown_edge + 1) + piece
        known = self.fits.get(key)
        if known is None:
            after = self.growth(piece)
            if last in (START, self.unknown_edge):
                known = after is not None
            else:
                before = self.growth(last)
                known = before is not None and after is not None and self._stay_apart(before, after)
            self.fits[key] = known
        return known

    def _stay_apart(self, before: tuple[list[float], list[str], list[str]], after: tuple[list[float], list[str], list[str]]) -> bool:
        (left, _, ends), (right, begins, _) = before, after
        by_text, scores, i, j = self.by_text, self.vocabulary.scores, 0, 0
        while True:
            between = by_text.get(ends[i] + begins[j])
            if between is not None:
                score = scores[between]
                if (i == len(left) or score > left[i]) and (j == len(right) or score >= right[j]):
                    return False
            if i < len(left) and (j == len(right) or left[i] >= right[j]):
                i += 1
            elif j < len(right):
                j += 1
            else:
                return True

    def extend(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``extends`` of many pairs."""
        last = np.where(last == self.unknown_edge, START, last)
        key = (last + 1) * (self.unknown_edge + 1) + piece
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        found = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, first, number = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[first]
            known = np.fromiter(map(self.extends, last[at].tolist(), piece[at].tolist()), bool, len(keys))
            found[new] = known[number]
            self.pair_keys[slot[at]], self.pair_fits[slot[at]] = keys, known
        return found

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of all occurrences."""
        places, keys = suffix_order(text, self.width)
        first = np.searchsorted(keys, self.low, "left")
        counts = np.searchsorted(keys, self.high, "right") - first
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        start = places[np.repeat(first, counts) + within]
        length, piece = np.repeat(self.lengths, counts), np.repeat(self.ids, counts)
        # Characters that are no piece themselves get an edge of their own.
        raw = np.frombuffer(text, np.uint8)
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        spans = np.diff(np.append(leads, len(raw)))
        single = np.zeros(len(raw) + 1, bool)
        span_at = np.zeros(len(raw) + 1, np.int64)
        span_at[leads] = spans
        single[start[length == span_at[start]]] = True
        bare = leads[~single[leads] & (raw[leads] != GAP[0])]
        start = np.concatenate([start, bare])
        length = np.concatenate([length, span_at[bare]])
        piece = np.concatenate([piece, np.full(len(bare), self.unknown_edge)])
        return start, length, piece

    def relax(self, size: int, starts: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the last piece and its start; ``starts`` are those of the words."""
        start, length, piece = edges
        if self.vocabulary.kind == "unigram":
            order = np.lexsort((length, start))
            last, back = [NONE] * (size + 2), [0] * (size + 2)
            for s in starts.tolist():
                last[s] = START
            worst = min(self.vocabulary.scores, default=0.0) - 10.0
            scores = [*self.vocabulary.scores, worst]
            best = [0.0] * (size + 2)
            for p, n, x in zip(*(e[order].tolist() for e in edges)):
                if last[p] != NONE:
                    value = best[p] + scores[x]
                    if last[p + n] == NONE or value > best[p + n]:
                        last[p + n], back[p + n], best[p + n] = x, p, value
            return np.array(last, np.int64), np.array(back, np.int64)
        last, back = np.full(size + 2, NONE, np.int64), np.zeros(size + 2, np.int64)
        last[starts] = START
        within = np.arange(size + 1) - np.repeat(starts, np.diff(np.append(starts, size + 1)))
        offset = np.minimum(within[start], LEVELS)
        order = np.argsort(offset.astype(np.uint8), kind="stable")
        start, end, piece = start[order], (start + length)[order], piece[order]
        bounds = np.searchsorted(offset[order], np.arange(LEVELS + 2)).tolist()
        for low, high in zip(bounds[:LEVELS], bounds[1:]):
            # Only one piece can end an encoding at a place.
            due = low + np.flatnonzero((last[start[low:high]] != NONE) & (last[end[low:high]] == NONE))
            due = due[self.extend(last[start[due]], piece[due])]
            last[end[due]], back[end[due]] = piece[due], start[due]
        rest = bounds[LEVELS]
        if rest < len(start):
            rest = rest + np.argsort(start[rest:], kind="stable")
            lasts, backs = last.tolist(), back.tolist()
            for p, e, x in zip(start[rest].tolist(), end[rest].tolist(), piece[rest].tolist()):
                before = lasts[p]
                if before != NONE and lasts[e] == NONE and self.extends(before, x):
                    lasts[e], backs[e] = x, p
            last, back = np.array(lasts, np.int64), np.array(backs, np.int64)
        return last, back

    def learn(self, words: list[str]) -> None:
        """Encode words that were not met before, about ``LEARN_CHARS`` at a time."""
        for part in in_parts(words, LEARN_CHARS):
            self._learn(part)

    def _learn(self, words: list[str]) -> None:
        """Encode words in one text with a byte between them that no UTF-8 text has."""
        text = GAP.join([w.encode("utf-8") for w in words])
        raw = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(raw == GAP[0])
        starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(text))
        last, back = self.relax(len(text), starts, self.edges(text))
        # From the ends of the words back to their starts, all short words at once.
        short = ends - starts <= LEVELS
        at, until, steps = ends[short], starts[short], []
        while len(at):
            steps.append(at)
            at = back[at]
            going = at > until
            at, until = at[going], until[going]
        for place, start in zip(ends[~short].tolist(), starts[~short].tolist()):
            step = array("q")
            while place > start:
                step.append(place)
                place = int(back[place])
            steps.append(np.frombuffer(step, np.int64))
        at = np.sort(np.concatenate(steps))
        piece, begin = last[at], back[at]
        bare = piece == self.unknown_edge
        if len(self.byte_ids):
            counts = np.where(bare, at - begin, 1)
            ids = np.repeat(piece, counts)
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            spelled = np.repeat(bare, counts)
            ids[spelled] = self.byte_ids[raw[(np.repeat(begin, counts) + inside)[spelled]]]
        else:
            counts, ids = np.ones(len(at), np.int64), np.where(bare, self.vocabulary.unknown, piece)
        sizes = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, np.append(starts, len(text) + 1), "right")])
        first = len(self.flat) + np.cumsum(sizes) - sizes
        self.numbers.update(zip(words, range(len(self.begin), len(self.begin) + len(words))))
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.begin.frombytes(first.astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.comes_back.frombytes(self._decode_to(ids, sizes, starts, ends, text).astype(np.int8).tobytes())

    def _decode_to(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: bytes) -> np.ndarray:
        """Whether the ids of each word decode to it."""
        decoded = b"".join(map(self.decoder.raw.__getitem__, ids.tolist()))
        until = np.concatenate([[0], np.cumsum(self.spans[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        if decoded == text.replace(GAP, b"") and np.array_equal(np.diff(until), ends - starts):
            return np.ones(len(starts), bool)
        places = zip(until[:-1].tolist(), until[1:].tolist(), starts.tolist(), ends.tolist())
        return np.array([decoded[a:b] == text[c:d] for a, b, c, d in places], bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        return self.encode_checked(texts)[:2]

    def encode_checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All ids, one text after the other, the number of ids of each text, and whether they decode to it.

        A text comes back if all its words do, each decoded once, and it has no U+2581 of its own.
        """
        if len(self.numbers) > MOST_WORDS:
            self.forget()
        words = [self.split(t) for t in texts]
        new = list(set().union(*words).difference(self.numbers))
        if new:
            self.learn(new)
        index = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64)
        per_text = np.array([len(ws) for ws in words], np.int64)
        size = np.frombuffer(self.size, np.int32).astype(np.int64) if len(self.size) else np.zeros(0, np.int64)
        begin = np.frombuffer(self.begin, np.int64) if len(self.begin) else np.zeros(0, np.int64)
        counts = size[index]
        total = int(counts.sum())
        places = np.repeat(begin[index] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        flat = np.frombuffer(self.flat, np.int32)[places] if total else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(counts)])
        text_ends = np.cumsum(per_text)
        per = ends[text_ends] - ends[text_ends - per_text]
        lost = np.concatenate([[0], np.cumsum(np.frombuffer(self.comes_back, np.int8)[index] == 0)]) if len(index) else np.zeros(1, np.int64)
        whole = (lost[text_ends] == lost[text_ends - per_text]).tolist()
        return flat.astype(np.int32), per, [ok and SPACE not in t for ok, t in zip(whole, texts)]


class Decoder:
    """Turns ids back into text."""

    def __init__(self, vocabulary: Vocabulary):
        self.raw = [p.encode("utf-8") for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.bytes_):
            self.raw[i] = bytes([value])
        for i in vocabulary.control:
            self.raw[i] = b""
        self.raw[vocabulary.unknown] = " \u2047 ".encode()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def in_parts(texts: Iterable[str], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``token_ids`` and ``round_trip`` (whether decoding gives the text back).

    Null and empty texts have no tokens (a null text comes back as the empty one). Repeated rows
    are encoded alike; an empty table gives an empty result.
    """
    slim = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            done = 0
            for texts in in_parts(TextSlices(batch.column(1))):
                flat, per, same = encoder.encode_checked(texts)
                offsets = np.concatenate([[0], np.cumsum(per)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), ids, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "round_trip"])
                done += len(texts)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, round_trip boolean")


class TextSlices:
    """The strings of an Arrow column, made one at a time."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __iter__(self) -> Iterator[str]:
        return (x.as_py() for x in self.column)


def decoded(tokens: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", ids_column: str = "token_ids") -> DataFrame:
    """``doc_id`` and ``text`` of every list of ids; null lists are empty texts, ids out of range an error."""
    slim = tokens.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{ids_column}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            texts = pa.array([decoder.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, text string")
