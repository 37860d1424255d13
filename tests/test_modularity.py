"""Modularity communities: planted groups, small graphs against every partition, local optimality."""

import itertools
import random

import pytest

from ontoweave.operators import graph


def quality(edges, of):
    m2 = 2 * sum(w for _, _, w in edges)
    inside = 2 * sum(w for a, b, w in edges if of[a] == of[b]) / m2
    k = {}
    for a, b, w in edges:
        k[of[a]] = k.get(of[a], 0) + w
        k[of[b]] = k.get(of[b], 0) + w
    return inside - sum(x * x for x in k.values()) / m2**2


def found(spark, edges):
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    rows = graph.modularity_communities(frame)
    of = {r["node"]: r["community"] for r in rows.collect()}
    assert graph.modularity(frame, rows).first()[0] == pytest.approx(quality(edges, of))
    return of


def test_planted_groups_are_found(spark):
    rnd = random.Random(4)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(60), 2) if rnd.random() < (0.5 if a // 15 == b // 15 else 0.02)]
    of = found(spark, edges)
    groups = {frozenset(n for n in of if of[n] == c) for c in of.values()}
    assert groups == {frozenset(range(k, k + 15)) for k in (0, 15, 30, 45)}
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = graph.communities(frame)
    assert quality(edges, of) >= graph.modularity(frame, labels).first()[0] - 1e-9


def test_hub_and_chain_end_at_an_optimum(spark):
    star = [(0, k, 1.0) for k in range(1, 30)]
    chain = [(100 + k, 101 + k, 2.0) for k in range(12)]
    edges = [*star, *chain, (5, 100, 1.0)]
    of = found(spark, edges)
    names = sorted(set(of.values()))
    best = quality(edges, of)
    for a, b in itertools.combinations(names, 2):  # no merge of two communities gains
        assert quality(edges, {n: a if c == b else c for n, c in of.items()}) <= best + 1e-9
    assert best > 0.4


def test_no_edges(spark):
    assert graph.modularity_communities(spark.createDataFrame([(1, 1, 1.0)], "src long, dst long, weight double")).count() == 0
