"""Bounded greedy assignment and components against sequential passes."""

import random

import pytest

from tabweld.operators import assign
from tabweld.operators.components import connected_components
from tests import brute


def frame(spark, edges):
    return spark.createDataFrame(edges, "left_id long, right_id long, score double").repartition(4)


def by_hand(edges):
    return brute.greedy([(s, a, b) for a, b, s in edges])


def test_a_chain_ends_in_few_rounds(spark, monkeypatch):
    edges = [e for i in range(5000) for e in ((i, i, 0.9 + i * 1e-6), (i, i + 1, 0.9 + i * 1e-6 + 5e-7))]
    rounds = []
    original = assign._without
    monkeypatch.setattr(assign, "_without", lambda *a: rounds.append(1) or original(*a))
    got = assign.greedy_assignment(frame(spark, edges))
    assert sorted(map(tuple, got.collect())) == by_hand(edges)
    assert len(rounds) <= 12


@pytest.mark.parametrize("scores", [1, 3, 1000])
def test_large_components_are_cut(spark, monkeypatch, scores):
    monkeypatch.setattr(assign, "ROUNDS", 1)
    monkeypatch.setattr(assign, "FOLD_EDGES", 60)
    random.seed(scores)
    one = {(random.randrange(40), random.randrange(40)) for _ in range(300)}  # one component
    many = {(100 + 5 * k + random.randrange(4), 100 + 5 * k + random.randrange(4)) for k in range(30) for _ in range(6)}
    edges = [(a, b, random.randrange(scores) / scores) for a, b in sorted(one | many)]
    edges += [(7, 1000 + i, 0.5) for i in range(90)]  # a row with very many edges of one score
    got = assign.greedy_assignment(frame(spark, edges))
    assert sorted(map(tuple, got.collect())) == by_hand(edges)


def test_components(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(300, 420)] + [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(9, 9)]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
