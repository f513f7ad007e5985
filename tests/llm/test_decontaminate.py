"""Decontamination against brute force: phrases, proximity, divided documents and odd input."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tabweld.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(items, size):
    out = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(tuple(words[i : i + size]), set()).add("null" if item is None else str(item))
    return out


def brute(docs, items, size):
    rows, known = [], windows_of(items, size)
    for doc, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for window, names in known.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    ids |= names
        rows.append((doc, len(words), len(hit), tuple(sorted(ids)), tuple(sorted(hit))))
    return sorted(rows, key=str)


def brute_near(docs, items, size, within):
    rows, known = [], windows_of(items, size)
    for doc, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for window, names in known.items():
            need, spans = Counter(window), set()
            for i in range(len(words)):
                for j in range(i, min(len(words), i + within)):
                    if not need - Counter(words[i : j + 1]):
                        spans.add((i, j))
                        break
            spans = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
            for i, j in spans:
                hit.update(range(i, j + 1))
                ids |= names
        rows.append((doc, len(words), len(hit), tuple(sorted(ids)), tuple(sorted(hit))))
    return sorted(rows, key=str)


def result(spark, docs, items, size=10, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(d, i, size, **more).collect()
    covered = [tuple(sorted({w for s in r.spans for w in range(s["from"], s["to"])})) for r in out]
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), c) for r, c in zip(out, covered)), key=str)


@pytest.fixture(scope="module")
def tables():
    random.seed(3)
    vocabulary = [*"abcdefg", "É", "ß9", "x1"]

    def some(n):
        return " ".join(random.choice(vocabulary) for _ in range(n))

    items = [(i, some(random.choice([1, 3, 5, 6, 9, 12]))) for i in range(25)]
    items += [(3, "A, b; C-d e F g a"), (None, "g f e d c b a"), (77, ""), (78, None), (79, "nowhere nothing never not known"), (79, "nowhere nothing never not known")]
    docs = [(i, some(random.choice([0, 1, 4, 30, 200]))) for i in range(60)]
    docs += [(i, f"{some(20)}! {(items[i % 25][1] or '').upper()}.\n{some(7)}") for i in range(60, 90)]
    docs += [(5, "a b c d e f g a"), (5, "a b c d e f g a"), (None, "g f e d c b a"), (None, None), (91, None), (92, ""), (93, "\x00 .,; \x7f")]
    docs += [(94, some(3000)), (95, "é" * 5000), (96, "-" * 5000)]
    return docs, items


@pytest.mark.parametrize("size", [1, 5, 10])
def test_phrases_equal_brute_force(spark, tables, size):
    docs, items = tables
    assert result(spark, docs, items, size) == brute(docs, items, size)


def test_divided_documents_equal_brute_force(spark, tables):
    docs, items = tables
    assert result(spark, docs, items, 5, segment_bytes=150) == brute(docs, items, 5)


@pytest.mark.parametrize("segment_bytes", [200, 1 << 20])
def test_proximity_equals_brute_force(spark, tables, segment_bytes):
    docs, items = tables
    docs = [d for d in docs if len(d[1] or "") < 1000]
    assert result(spark, docs, items, 5, within=7, segment_bytes=segment_bytes) == brute_near(docs, items, 5, 7)


def test_report_on_bundled_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert any(w[2] for w in want)
    for doc, n_words, n_hit, ids, _ in want:
        r = rows[doc]
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, len(ids), digest, n_hit > 0)


def test_odd_input(spark, odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id AS item_id", "text", "row", "line AS doc_id").where("item_id in (4, 5)")
    out = decontaminate.contaminated(odd_docs, items).collect()
    assert len(out) == odd_docs.count()
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out), key=str) == [w[:4] for w in want]
    assert decontaminate.contaminated(no_docs, items).count() == 0
    clean = decontaminate.report(odd_docs, items.limit(0)).collect()
    assert len(clean) == odd_docs.count() and not any(r.contaminated for r in clean)


def test_all_rows_of_an_item_count_for_its_id(spark):
    rows = result(spark, [(1, "p q"), (2, "r")], [(7, "p q"), (7, "r"), (8, "r")], 2)
    assert [r[:4] for r in rows] == [(1, 2, 2, ("7",)), (2, 1, 1, ("7", "8"))]
