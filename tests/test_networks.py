"""Betweenness by levels and triangles by orientation, against brute force, with hubs."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from lodestone.operators import events as E


def shortest(nodes, edges):
    """Of each pair of ends the shortest paths, as lists of nodes."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    for s in nodes:
        paths, seen = {s: [[s]]}, {s}
        while paths:
            new = defaultdict(list)
            for v, ps in paths.items():
                for w in after[v] - seen:
                    new[w] += [p + [w] for p in ps]
            yield from new.items()
            seen |= set(new)
            paths = new


def brute(edges):
    nodes = {x for e in edges for x in e}
    credit = dict.fromkeys(nodes, 0.0)
    for _, paths in shortest(nodes, edges):
        for p in paths:
            for v in p[1:-1]:
                credit[v] += 1 / len(paths)
    return credit


def graph(seed, n, m):
    rng = random.Random(seed)
    return {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}


@pytest.mark.parametrize("most, sources", [(512, 4096), (12, 20)])
def test_betweenness(spark, most, sources):
    games = {1: graph(1, 14, 30), 2: graph(2, 9, 12), 3: {(5, 6)}, 4: {(i, i + 1) for i in range(8)} | {(8, 0)}}
    rows = [(g, a, b, 1) for g, es in games.items() for a, b in es]
    got = {r["player"]: r["betweenness"] for r in E.betweenness(spark.createDataFrame(rows + rows[:3] + [(1, 3, 3, 1)], "game long, src long, dst long, n int"), most, sources).collect()}
    each = defaultdict(list)
    for es in games.values():
        n = len({x for e in es for x in e})
        for v, c in brute(es).items():
            each[v].append(c / ((n - 1) * (n - 2)) if n > 2 else c)
    assert got == pytest.approx({v: sum(c) / len(c) for v, c in each.items()})


def test_betweenness_of_a_large_game(spark):
    """20,000 players in one game, in rings of five: no task sees more than rows of tables."""
    rows = spark.range(20_000).selectExpr("1L AS game", "id AS src", "id div 5 * 5 + (id + 1) % 5 AS dst", "1 AS n")
    got = E.betweenness(rows, sources=1 << 16)
    first = got.first()["betweenness"]
    assert got.count() == 20_000 and first == pytest.approx(6 / (19_999 * 19_998)) and got.where(f"abs(betweenness - {first}) > 1e-15").count() == 0


def test_triangles(spark):
    links = {(1, min(e), max(e)) for e in graph(5, 25, 120)} | {(2, 0, i) for i in range(1, 30)} | {(2, 3, 4), (2, 4, 5), (2, 3, 5)}
    degree, tri = E.triangles(spark.createDataFrame(sorted(links), "game long, a long, b long"), "game")
    near = defaultdict(set)
    for g, a, b in links:
        near[g, a].add(b)
        near[g, b].add(a)
    assert {(r["game"], r["node"]): r["d"] for r in degree.collect()} == {k: len(v) for k, v in near.items()}
    want = {(g, x): sum(b in near[g, a] for a, b in itertools.combinations(near[g, x], 2)) for g, x in near}
    assert {(r["game"], r["node"]): r["tri"] for r in tri.collect()} == {k: v for k, v in want.items() if v}


def test_a_hub_makes_no_wedge(spark):
    star = spark.range(1, 100_001).selectExpr("1L AS game", "0L AS a", "id AS b")
    degree, tri = E.triangles(star, "game")
    assert degree.agg({"d": "max"}).first()[0] == 100_000 and tri.count() == 0
    got = E.clustering(star.selectExpr("game", "a AS src", "b AS dst", "1 AS n"))
    assert got.where("clustering <> 0").count() == 0 and got.count() == 100_001
