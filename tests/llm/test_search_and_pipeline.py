"""Top-k search against brute force, and the pipeline stage by stage."""

import random

import numpy as np

import corpus_pipeline
from tabweld.llm import mixing, pieces, quality, queries, topk


def best_by_hand(rows, k, every):
    out = []
    for q, x in rows:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k=5, every=5):
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(frame, topk.F.col("vec_id") % every == 0, k).collect())


def test_top_k_by_hand(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 60)
    monkeypatch.setattr(topk, "PAGE_ROWS", 8)
    monkeypatch.setattr(topk, "REGIONS", 4)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    random.seed(8)
    centres = [[random.randint(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + random.randint(-9, 9) for c in random.choice(centres)]) for i in range(400)]
    rows += [(400 + i, [5, 5, 5, 5, 5, 5]) for i in range(200)] + [(600 + i, [0] * 6) for i in range(10)]
    random.shuffle(rows)
    assert search(spark, rows) == best_by_hand(rows, 5, 5)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 0.5]), (None, [1.0, 1.0]), (7, []), (10, [1.0, 2.0]), (10, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, v string, region int")
    whole = topk.whole_vectors(frame)
    assert {r.vec_id: r.v for r in whole.collect()} == {0: [256, 512], 5: [-1, 128], 7: [], 10: [256, 512]}
    got = sorted(tuple(r) for r in topk.top_k(whole, topk.F.col("vec_id") % 5 == 0, 5).collect())
    assert got == best_by_hand([(0, [256, 512]), (5, [-1, 128]), (7, [0, 0]), (10, [256, 512])], 5, 5)
    assert topk.top_k(whole.where("false"), topk.F.col("vec_id") % 5 == 0, 5).count() == 0
    assert topk.top_k(whole.where("vec_id = 0"), topk.F.col("vec_id") % 5 == 0, 5).count() == 0


def test_an_id_with_several_vectors(spark):
    rows = [(0, [9, 9]), (0, [8, 8]), (0, [7, 7])] + [(i, [i % 5, 1]) for i in range(1, 12)]
    got = search(spark, rows, k=3, every=50)
    assert [g[:3] for g in got] == [(0, 1, 4), (0, 2, 9), (0, 3, 3)]


def best_of_ids(rows, k, every):
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for own, x in rows:
            if own == q:
                for i, y in rows:
                    if i != q:
                        best[i] = max(best.get(i, -(10**9)), sum(a * b for a, b in zip(x, y)))
        ranked = sorted((-s, i) for i, s in best.items())
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:k])]
    return out


def test_two_ids_with_many_vectors(spark, monkeypatch):
    rows = [(50, [90 + i, 80]) for i in range(10)] + [(7, [95 + i, 85]) for i in range(10)] + [(i, [i, 1]) for i in range(1, 7)]
    got = search(spark, rows, k=5, every=50)
    assert len(got) == 5 and got == best_of_ids(rows, 5, 50)
    monkeypatch.setattr(topk, "TREE_ROWS", 40)
    monkeypatch.setattr(topk, "PAGE_ROWS", 8)
    monkeypatch.setattr(topk, "REGIONS", 4)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 5)
    random.seed(12)
    rows = [(random.choice([0, 5, 5, *range(40)]), [random.randint(-9, 9) for _ in range(3)]) for _ in range(500)]
    assert search(spark, rows, k=6, every=5) == best_of_ids(rows, 6, 5)


def test_pages_avoid_distances():
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] * 1000 + rng.normal(size=(3000, 8)) * 5).astype(np.int64)
    largest = float((x.astype(float) ** 2).sum(axis=1).max())
    lift = topk.lifts(x, largest)
    built = topk.build_pages(x, lift, x[0], lift[0], 32)
    assert sorted(i for leaf, own, *_ in built if leaf for i in own) == list(range(3000))

    class Row:
        pass

    tree = {}
    for number, (leaf, own, above, radius, child) in enumerate(built):
        r = Row()
        r.leaf, r.vectors, r.lift, r.above, r.radius, r.child = leaf, x[own].tobytes(), lift[own].tobytes(), above.tobytes(), radius.tobytes(), child.tobytes()
        r.ids = own.astype(np.int64).tobytes()
        tree[number] = topk.Page(r, 8)
    for q in x[:20]:
        start = topk.distances(q[None, :], np.zeros(1), x[:1], lift[:1])[0, 0]
        best, computed = topk.best_first(tree, q, start, largest, None, 4)
        scores = x @ q
        want = sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda e: (-e[0], e[1]))[:4]
        assert best == want and computed < 2500


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = queries_written(spark, stage(spark, docs, sf))
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    kept = {r.doc_id for r in quality.report(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    first, lines, near, mixed, last = (out[n] for n, _ in corpus_pipeline.STAGES)
    assert {r.doc_id: r.text for r in first.collect()} == {i: before[i].text for i in kept}
    assert {r.doc_id for r in lines.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert {r.doc_id for r in near.collect()} < kept
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, near.collect()))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    decoded = {r.doc_id: r.text for r in pieces.decoded(last, queries.vocabulary()).collect()}
    assert decoded == texts and last.where("not round_trip").count() == 0
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, last.collect()))


def queries_written(spark, frame):
    from tabweld.session import materialize

    return materialize(frame, "stage")


def test_the_mixture_reaches_the_result(spark, tmp_path, monkeypatch):
    """With many files, also of unlike sizes, sorted prefixes of the result keep the weights."""
    rows = [(i, f"text {i} " * (1 + i % 40), "big" if i % 4 else "small") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    ends = [s for s in corpus_pipeline.STAGES if s[0] in ("mixing sources", "sentencepiece")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", ends)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.position for r in out) == list(range(2000)) and {r.doc_id for r in out} == set(range(2000))
    order = [r.doc_id for r in sorted(out, key=lambda r: r.position)]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    slots = sorted((r.slot, r.place, r.row.doc_id) for r in mixing.mixed(docs).collect())
    assert order == [d for *_, d in slots]
    weights = mixing.smoothed_weights({"big": 1500, "small": 500})
    for n in range(16, 1200, 16):
        assert abs(sum(d % 4 > 0 for d in order[:n]) / n - weights["big"] / 1000) <= 16 / n


def test_pipeline_of_odd_docs(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = queries_written(spark, stage(spark, docs, ""))
        docs.count()
