"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import pytest

from tabweld.llm import periodic, queries


def brute(words, shortest):
    found = set()
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(shortest, 2 * p):
                part = words[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.add((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, found):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in found)]


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_runs_equal_brute_force(letters):
    random.seed(letters)
    for _ in range(400):
        words = [random.choice("abcdefghi"[:letters]) for _ in range(random.randrange(70))]
        if words and random.random() < 0.4:
            a = random.randrange(len(words))
            p = 1 + random.randrange(1 + (len(words) - a) // 3)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        for shortest in (2, 12):
            assert periodic.runs(words, shortest) == brute(words, shortest)


def test_overlapping_runs_and_long_repeats():
    random.seed(4)
    once = [str(random.randrange(300)) for _ in range(700)]
    words = [*once, *once, "x", *["a", "b"] * 9, *["b"] * 14, *once[:5]]
    found = periodic.runs(words)
    assert found == brute(words, 12)
    assert (0, 1400, 700) in found and any(p == 1 for _, _, p in found)
    assert periodic.without_repeats(words, found) == kept(words, found)


def test_extensions_equal_brute_force():
    random.seed(5)
    text = [random.randrange(1, 4) for _ in range(300)] * 2
    import numpy as np

    a, b = np.array([random.sample(range(len(text) + 1), 2) for _ in range(3000)]).T
    got = periodic.Extensions(text, False).common(a, b)
    for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
        assert text[x : x + n] == text[y : y + n] and (text[x + n : x + n + 1] != text[y + n : y + n + 1] or x + n == len(text) or y + n == len(text))


def by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(kept(words, found)))))


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 9000]
    random.seed(6)
    rows += [(1000 + i, " ".join(random.choice(["p", "q", "rr\t"]) for _ in range(random.randrange(90)))) for i in range(150)]
    rows += [(7, None), (8, ""), (None, "a " * 30), (9, "a " * 30), (9, "a " * 30), (None, None), (32, "\x0b\x0c one\xa0two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [by_hand(*r) for r in rows]
    assert sum(w[1] > 0 for w in want) > 20
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_odd_input(spark, odd_docs, no_docs):
    rows = periodic.with_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    long = [r for r in rows if r.n_words >= 30_000]
    assert len(long) == 2 and all((r.runs[0].start, r.runs[0].period) == (0, 700) and len(r.collapsed.split()) in (700, 701) for r in long)
    assert periodic.with_runs(no_docs).count() == 0
    assert periodic.report(periodic.with_planted_periods(odd_docs)).count() == odd_docs.count()
