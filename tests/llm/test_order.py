"""Sharding and mixing: laws of the result, on real, odd and empty input."""

import zlib
from collections import Counter, defaultdict

import pytest

from tabweld.llm import mixing, sharding

SF = "/root/testdata/sf0.01"


def shards(docs, n=40):
    return sharding.shard_by_bytes(sharding.keyed_rows(docs), shards=n).collect()


def law_of_bytes(rows, n):
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(0 <= s < n for s in held)
    assert all(abs(held[s] - total / n) <= most for s in range(n))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shards(docs)
    law_of_bytes(rows, 40)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len(t) + 16, zlib.crc32(t)) for d, t in texts.items()}


def test_one_text_with_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(9000)]
    law_of_bytes(shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)), 40)


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_rows_are_divided(spark, doc_id):
    """One row two thirds of the time: it is drawn by occurrence, and no part holds all of it."""
    rows = [(doc_id, "a repeated row " * 5)] * 6000 + [(100 + i, f"text {i} " * (i % 30)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    law_of_bytes(shards(docs), 40)
    keyed = sharding.keyed_rows(docs).withColumn("written", sharding.F.monotonically_increasing_id())
    total = keyed.agg(sharding.F.sum("size")).first()[0]
    assert 700 < sharding.drawn(keyed, total, 1000).count() < 1300


def test_shards_of_odd_docs(odd_docs, no_docs):
    rows = shards(odd_docs, 3)
    assert len(rows) == odd_docs.count()
    law_of_bytes(rows, 3)
    assert shards(no_docs) == []


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assigned = sharding.shard_by_bytes(sharding.keyed_rows(docs), shards=4)
    sharding.write_shards(docs, assigned, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in assigned.collect()}


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [7, 2, 1], [5, 5, 3, 3, 2, 1], [97, 2, 1]])
def test_deadlines_are_met(weights):
    total = sum(weights)
    order, done = mixing.earliest_deadlines(weights, total), [0] * len(weights)
    for now, i in enumerate(order):
        assert done[i] * total // weights[i] <= now < -(-(done[i] + 1) * total // weights[i])
        done[i] += 1
        assert all(abs(done[j] * total - weights[j] * (now + 1)) < total for j in range(len(weights)))
    assert done == weights


def mixture(docs, **options):
    return mixing.mixed(docs, **options).selectExpr("row.doc_id", "source", "phase", "block", "release", "deadline", "slot", "place").collect()


def law_of_mixture(rows, weights, block_rows):
    assert all(r.release <= r.slot < r.deadline for r in rows)
    blocks = {}
    for r in rows:
        assert blocks.setdefault(r.slot, (r.source, r.block, r.phase)) == (r.source, r.block, r.phase)
    assert sorted(blocks) == list(range(len(blocks)))
    places = defaultdict(list)
    for r in rows:
        places[r.slot].append(r.place)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= block_rows for p in places.values())
    # Within a phase no source is a block or more away from its share.
    left = {s: 1 + max(b for t, b, _ in blocks.values() if t == s) for s in {t for t, _, _ in blocks.values()}}
    done, phase, start = Counter(), None, 0
    for slot in range(len(blocks)):
        source, _, now = blocks[slot]
        if now != phase:
            for s, n in done.items():
                left[s] -= n
            live, done, phase, start = {s: weights[s] for s, n in left.items() if n > done[s] - done[s]}, Counter(), now, slot
            live = {s: w for s, w in live.items() if left[s] > 0}
        done[source] += 1
        total = sum(live.values())
        assert all(abs(done[s] * total - w * (slot + 1 - start)) < total for s, w in live.items())


def test_mixture_with_given_weights(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else ("mid" if i % 2 else "small")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"big": 5, "mid": 3, "small": 2}
    out = mixture(docs, weights=weights, block_rows=7)
    assert sorted(r.doc_id for r in out) == list(range(3000))
    law_of_mixture(out, weights, 7)
    ordered = [r.doc_id for r in mixing.in_mixed_order(docs, weights=weights, block_rows=7).collect()]
    assert ordered == [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.place))]


def test_mixture_with_one_large_source(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 10 < 7, 'hot', concat('s', id % 40)) AS source")
    out = mixture(docs)
    sizes = Counter(r.source for r in out)
    assert sum(sizes.values()) == 40_000
    law_of_mixture(out, mixing.smoothed_weights(sizes), 16)


def test_mixture_of_very_many_sources(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', concat('s', id)) AS source")
    out = mixture(docs)
    sizes = Counter(r.source for r in out)
    assert len(out) == 5000 and len(sizes) == 2501
    law_of_mixture(out, mixing.smoothed_weights(sizes), 16)


def test_joined_schedules_equal_broadcast_ones(spark, odd_docs, no_docs, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 10 < 7, 'hot', concat('s', id % 40)) AS source")
    want = [sorted(map(repr, mixture(d, block_rows=2))) for d in (docs, odd_docs, no_docs)]
    monkeypatch.setattr(mixing, "MOST_ENTRIES", 0)
    assert want == [sorted(map(repr, mixture(d, block_rows=2))) for d in (docs, odd_docs, no_docs)]


def test_mixture_of_odd_docs(odd_docs, no_docs):
    out = mixture(odd_docs, block_rows=2)
    assert len(out) == odd_docs.count() and None in {r.source for r in out}
    assert mixing.in_mixed_order(odd_docs).columns == odd_docs.columns
    assert sorted(map(repr, mixing.in_mixed_order(odd_docs).collect())) == sorted(map(repr, odd_docs.collect()))
    assert mixture(no_docs) == [] and mixing.in_mixed_order(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(odd_docs, weights={"s0": 0})


def test_smoothed_weights():
    weights = mixing.smoothed_weights({"a": 1000, "b": 10, None: 1})
    assert sum(weights.values()) == mixing.PARTS and weights["a"] > weights["b"] > weights[None] >= 1
