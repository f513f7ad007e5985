"""Cross-tokenizer alignment against plain counting with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabweld.llm import alignment, queries


@pytest.fixture(scope="module")
def pair():
    return queries.tokenizer_pair()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@cache
def bytes_of_a(a, i):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown}
    of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return bytes(of[c] for c in a.id_to_token(i))


@cache
def bytes_of_b(b, i):
    return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def groups(libraries, text):
    a, b = libraries
    if not text:
        return []
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    tokens = [[bytes_of_a(a, i) for i in ids[0]], [bytes_of_b(b, i) for i in ids[1]]]
    if any(b"".join(t) != (" " + text).encode() for t in tokens):
        return []
    ends = []
    for side in tokens:
        at, out = 0, []
        for t in side:
            at += len(t)
            out.append(at)
        ends.append(out)
    shared = set(ends[0]) & set(ends[1])
    out, sides = [], []
    for side in (0, 1):
        cut, now = [], []
        for i, end in zip(ids[side], ends[side]):
            now.append(i)
            if end in shared:
                cut.append(now)
                now = []
        sides.append(cut)
    out = list(zip(*sides))
    return out


def brute(libraries, rows):
    cut = [(doc, groups(libraries, text)) for doc, text in rows]
    counts = Counter()
    for _, found in cut:
        counts.update({(x, y) for a, b in found for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc, found in cut:
        links = [(x, y) for a, b in found for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        sizes = (sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links))
        out.append((doc, *sizes, sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return sorted(out, key=str), counts


def texts():
    random.seed(2)
    odd = ["a", "  two  spaces ", "\t\ttabs\n\n\nlines \n", "日本語 ÄÖ ß 🎉🎉", "<|endoftext|> <s> </s> <unk> <0x41>", "it's we've 'tis", "▁ not kept", "x" * 3000, "ab" * 900, "!" * 777, " ", "\x00\x01\x85　", "12345 6,789.0e-3", "erblest thwhou " * 40]
    alphabet = "abcdeé 日\n.1'A"
    odd += ["".join(random.choice(alphabet) for _ in range(random.randrange(200))) for _ in range(60)]
    return odd


def test_counts_equal_brute_force(spark, pair, libraries):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "a"), (3, "a"), (None, "a b"), (None, None), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, counts = brute(libraries, rows)
    for block_bytes in (1, 1 << 20):
        pairs, result = alignment.aligned(docs, pair, block_bytes=block_bytes)
        assert sorted(map(tuple, result.collect()), key=str) == want
        assert {(r.a_id, r.b_id): r.docs for r in pairs.collect()} == counts
    assert sum(r.same for r in pairs.collect()) > 50


def test_groups_and_round_trip(spark, pair, libraries):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = alignment.groups_of(spark.createDataFrame(rows, "doc_id long, text string"), pair).collect()
    for r in got:
        assert [(g.a, g.b) for g in r.groups] == groups(libraries, rows[r.doc_id][1])
        if r.groups:
            assert b"".join(pair.a_tokens[i] for g in r.groups for i in g.a).decode() == " " + rows[r.doc_id][1]


def test_query_equals_brute_force_on_bundled_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_alignment(spark, sf).collect()), key=str) == brute(libraries, rows)[0]


def test_odd_input(spark, pair, odd_docs, no_docs, libraries):
    pairs, result = alignment.aligned(odd_docs, pair)
    want, _ = brute(libraries, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(map(tuple, result.collect()), key=str) == want
    pairs, result = alignment.aligned(no_docs, pair)
    assert pairs.count() == 0 and result.count() == 0
