"""Joins by edit distance against all pairs."""

from __future__ import annotations

import random

import pytest

from lodestone.operators.names import closest, pairs_within


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fixture():
    rng = random.Random(4)
    base = ["jose maria gimenez", "josé mária giménez", "kylian mbappe", "ronaldo", "", "a", "ab", "aba", "abab", "luka modric"]
    typos = []
    for name in ("kylian mbappe", "luka modric"):
        for i in range(len(name) + 1):  # an edit at every place, and a second one anywhere
            once = [name[:i] + name[i + 1 :], name[:i] + "x" + name[i:], name[:i] + "x" + name[i + 1 :]]
            k = rng.randint(0, len(name) - 1)
            typos += once + [x[:k] + "y" + x[k:] for x in once]
    same_start = [f"player number {rng.randint(0, 300):03d}" for _ in range(150)]
    short = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    left = base + typos + same_start[:60] + short[:20] + [None, "ronaldo", "ronaldo"]
    return left, base + same_start + short + [None, "kylian mbapp", "ronaldo"]


@pytest.mark.parametrize("edits, frequent", [(0, 64), (1, 64), (2, 64), (2, 3), (1, 0), (3, 20)])
def test_pairs(spark, edits, frequent):
    left, right = fixture()
    a, b = (spark.createDataFrame([(x, 1) for x in side], "name string, known int").select("name") for side in (left, right))
    got = [tuple(r) for r in pairs_within(a, b, edits, frequent).collect()]
    want = {(x, y, distance(x, y)) for x in set(left) - {None} for y in set(right) - {None} if distance(x, y) <= edits}
    assert len(got) == len(set(got)) and set(got) == want


def test_closest(spark):
    left, right = fixture()
    a, b = (spark.createDataFrame([(x,) for x in side], "name string") for side in (left, right))
    want = set()
    for x in set(left) - {None}:
        near = {y: distance(x, y) for y in set(right) - {None}}
        want |= {(x, y, d) for y, d in near.items() if d == min(near.values()) and d <= 2}
    assert {tuple(r) for r in closest(a, b).collect()} == want
    assert closest(a.limit(0), b).count() == 0 and closest(a, b.limit(0)).count() == 0


def test_a_common_beginning_proposes_no_square(spark):
    """Names that share most of their text meet by shortened forms: candidates stay in proportion to the names."""
    names = spark.range(3000).selectExpr("concat('a very common beginning ', lpad(cast(id * 7919 % 1000003 as string), 9, '0')) AS name")
    got = pairs_within(names, names, 1)
    assert got.where("d = 0").count() == 3000


def test_names_are_never_broadcast(spark):
    """Staged names are small files of many rows; a broadcast of them would pass through the driver."""
    left = spark.range(300).selectExpr("concat('customer#', lpad(cast(id * 7 as string), 9, '0')) AS name")
    from lodestone.operators import names as N

    plans, stage = [], N.stage
    N.stage = lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, label)
    try:
        N.pairs_within(left, left, 1).count()
    finally:
        N.stage = stage
    assert plans and not any("BroadcastExchange" in p or "BroadcastHashJoin" in p for p in plans)
