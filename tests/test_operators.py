"""Hand-computed cases and invariants of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import distributions as D
from lodestone.functions.columns import l2, sanitized
from lodestone.operators import events as E
from lodestone.operators import inference as I
from lodestone.operators import models as M
from lodestone.operators import ranking as R
from lodestone.operators import samples as S
from lodestone.operators import vectors as V
from lodestone.operators.graph import connected_components
from lodestone.plans.numbering import numbered, running_sum


def ranked(spark, sims, relevant):
    """Ranks of items 1.. for query 0 when their similarities are these (the query's own comes first)."""
    order = sorted((i for i in range(len(sims)) if i), key=lambda i: (-sims[i], i))
    return spark.createDataFrame([(0, order.index(r)) for r in relevant], "q long, rank long")


def test_metrics_of_three_relevant_items(spark):
    # Others in order: 5, 1, 3 (tied with 1, the smaller id first), 6, 2, 4.
    m = R.query_metrics(ranked(spark, [2.0, 0.7, 0.2, 0.7, -0.4, 0.8, 0.6], {3, 4, 5}), "rank").first()
    assert (m["hit_1"], m["hit_5"], m["hit_10"], m["recall_10"], m["mrr"]) == (1, 1, 1, 1, 1)
    assert m["ap"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 6) / 3)


def test_metrics_of_an_item_beyond_the_cut(spark):
    m = R.query_metrics(spark.createDataFrame([(7, 11), (7, 3)], "q long, rank long"), "rank").first()
    assert (m["hit_1"], m["hit_5"], m["recall_10"], m["mrr"]) == (0, 1, 0.5, 0.25) and m["ap"] == pytest.approx((1 / 4 + 2 / 12) / 2)


def test_relevant_item_outside_the_group_comes_after_the_group(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 1), (2, [0.0, 1.0], 0), (3, [0.5, 0.5], 0)], "id long, vec array<double>, grp int")
    r = R.rank_counts(df, spark.createDataFrame([(0, 1)], "q long, r long")).first()
    assert (r["rank_all"], r["rank_group"]) == (0, 3)  # behind 2 and 3 of the group, and behind 0 itself, which is masked and has the smaller id


def vectors(spark, n=60, d=8, seed=3, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (n, d)).astype(float) if ties else rng.normal(size=(n, d))
    return spark.createDataFrame([(i, x[i].tolist(), i % 4) for i in range(n)], "id long, vec array<double>, grp int"), x


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block", [7, 1024])
def test_rank_counting_equals_sorting(spark, ties, block):
    df, x = vectors(spark, ties=ties)
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60) if (i * 7 + 1) % 60 != i], "q long, r long")
    got = {(r["q"], r["r"]): (r["rank_all"], r["rank_group"]) for r in R.rank_counts(df, edges, block).collect()}
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n < 1e-12, 1, n)
    s = np.round(u @ u.T, 12)
    for (q, r), found in got.items():
        every = sorted((c for c in range(60) if c != q), key=lambda c: (-s[q, c], c))
        group = sorted(range(60), key=lambda c: (1, 0, c) if c == q or c % 4 != q % 4 else (0, -s[q, c], c))
        assert found == (every.index(r), group.index(r))


def test_scaling_leaves_ranks(spark):
    df, _ = vectors(spark)
    edges = spark.createDataFrame([(1, 5), (2, 9)], "q long, r long")
    scaled = df.withColumn("vec", F.transform("vec", lambda x: x * 3.5))
    assert sorted(R.rank_counts(df, edges).collect()) == sorted(R.rank_counts(scaled, edges).collect())


def test_top_k_blocks(spark):
    df, _ = vectors(spark, ties=True)
    assert sorted(R.top_k(df, df, 5, block=7).collect()) == sorted(R.top_k(df, df, 5).collect())


def test_vectors_edges(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [float("nan"), float("inf")])], "id long, vec array<double>")
    assert [r[0] for r in df.select(l2("vec")).collect()][:2] == [[0, 0], [0.6, 0.8]]
    assert df.select(sanitized("vec")).collect()[2][0] == [0, 50] and df.select(sanitized("vec", None)).collect()[2][0] == [0, 0]
    assert V.discovered(spark.createDataFrame([(0, 0, 0, 0)], "f10 int, f2 int, name int, fx int"), "f") == ["f2", "f10"]


def test_percentile_average_ties(spark):
    rows = V.percentile_ranks(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "id long, a double"), ["a"])
    assert {r["id"]: round(r["pct"], 6) for r in rows.collect()} == {1: round(100 / 3, 6), 2: round(250 / 3, 6), 3: round(250 / 3, 6)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 80)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k long").repartition(7)
    assert all(r["k"] == r["idx"] for r in numbered(df, "k").collect())


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(i % 10), float(v)) for i, v in enumerate(rng.normal(0.1, 1, 300))]
    df = spark.createDataFrame(rows, "q long, cluster long, value double")
    a, b, c = (I.block_bootstrap(df, 100, s).first() for s in ("x", "x", "y"))
    assert a == b and (a["low"], a["high"]) != (c["low"], c["high"])
    zero = I.block_bootstrap(df.withColumn("value", F.lit(0.0)), 50).first()
    assert zero["p"] == 1 and zero["low"] == zero["high"] == 0


def test_holm_stops(spark):
    tests = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.012), ("d", 0.03)], "name string, p double")
    assert {r["name"]: r["rejected"] for r in I.holm(tests).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_t(spark):
    assert D.t_two_sided(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)
    assert D.t_quantile(0.8, 21) == pytest.approx(0.859074, abs=1e-5)
    assert D.t_power(0.0, 1.0, 12) == pytest.approx(0.05, abs=1e-3)
    one = I.cluster_t(spark.createDataFrame([(1, 1.0)], "cluster long, value double")).first()
    assert one["p"] is None and one["se"] is None


def test_betweenness_and_hull():
    path = E._betweenness(np.array([1, 2, 3]), np.array([2, 3, 4]))
    assert path[2] == pytest.approx(2 / 6) and path[1] == 0 and path[3] == pytest.approx(2 / 6)
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)
    assert E.area(E.hull(square)) == 4 and E.area(E.hull(square[:2])) == 0


def test_pressing_against_search(spark):
    rng = random.Random(2)
    rows = [(i, i % 9, rng.randrange(3), i // 100, 1 + i % 100 // 50, i % 50 * 3, rng.choice(["pass", "tackle"]), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "action_id long, player long, team long, game long, period int, t long, type string, ok boolean")
    want = set()
    for k, r in enumerate(rows):
        if r[6] == "tackle":
            for back in range(1, 20):
                o = rows[k - back] if k >= back else None
                if o is None or o[3] != r[3]:
                    break
                if o[2] != r[2]:
                    want.add((r[0], r[5] - o[5] if o[4] == r[4] else None))
                    break
    assert {(r["action_id"], r["dt"]) for r in E.pressing(df).collect()} == want


def test_whitening(spark):
    df, x = vectors(spark, 400, 5)
    w = np.array([r["vec"] for r in M.whitened(df, M.zca(df), unit=False).collect()])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(5), atol=1e-3)
    p = np.array([r["vec"] for r in M.principal(df, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(p), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    split = lambda d: {r["k"] for r in S.entity_split(d, "k", 0.3, "s").where("held_out").collect()}
    assert split(df) == split(df.repartition(11)) and len(split(df)) == 60
    assert len(S.entity_split(df.limit(1), "k", 0.3, "s").where("held_out").collect()) == 1


def test_threat_surface(spark):
    rows = [("shot", True, 100.0, 30.0, 0.0, 0.0), ("shot", False, 100.0, 30.0, 0.0, 0.0), ("pass", True, 50.0, 30.0, 100.0, 30.0), ("pass", False, 50.0, 30.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "type string, ok boolean, x0 double, y0 double, x1 double, y1 double")
    got = sorted(round(r["xt"], 6) for r in E.threat_surface(df).collect())
    assert got == [0.25, 0.5] and math.isclose(max(got), 0.5)


def test_factors_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 3)) @ rng.random((3, 12)) * (rng.random((40, 12)) > 0.3)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>").repartition(5)
    h = M.fit_factors(df, 3, seed=2, rounds=15, steps=10)
    want = np.random.default_rng(2).random((3, 12)) + 0.1
    for _ in range(15):
        w = np.ones((40, 3))
        for _ in range(10):
            w *= (x @ want.T) / np.maximum(w @ (want @ want.T), 1e-12)
        for _ in range(10):
            want = want * (w.T @ x) / np.maximum((w.T @ w) @ want, 1e-12)
    assert np.allclose(h, want, rtol=1e-6, atol=1e-9) and (h >= 0).all()
    new = spark.createDataFrame([(0, x[0].tolist()), (1, [0.0] * 12)], "id long, vec array<double>")
    w = np.array([r["vec"] for r in M.factor_weights(new, h).orderBy("id").collect()])
    assert (w >= 0).all() and np.allclose(w[1], 0, atol=1e-9)
    assert np.linalg.norm(w[0] @ h - x[0]) <= np.linalg.norm(x[0])


def test_probe_tells_classes_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 4 * np.eye(4)[i % 3]).tolist(), "abc"[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    said = M.probe(df.where("id < 180"), df.where("id >= 180"), "label")
    whole = M.overall_metrics(said).first()
    pairs = [(r["label"], r["predicted"]) for r in said.collect()]
    f1 = []
    for c in "abc":
        hit, called, real = sum(p == (c, c) for p in pairs), sum(p[1] == c for p in pairs), sum(p[0] == c for p in pairs)
        f1.append(2 * hit / (called + real))
    assert whole["n"] == 60 and whole["accuracy"] == pytest.approx(np.mean([a == b for a, b in pairs])) and whole["accuracy"] > 0.9
    assert whole["macro_f1"] == pytest.approx(np.mean(f1))
    one = M.probe(df.where("label = 'a'"), df.where("id >= 180"), "label")
    assert {r["predicted"] for r in one.collect()} == {None} and M.overall_metrics(one).first()["accuracy"] == 0


def test_match_outcome_counts_what_it_says(spark):
    from lodestone.plans.catalog import reference_queries
    from tests.conftest import SF

    r = reference_queries()["match_outcome"](spark, SF).first()
    games = reference_queries()["match_features"](spark, SF).toPandas()
    assert 0 < r["n"] < len(games) and 0 <= r["accuracy"] <= 1 and r["majority"] >= 1 / 3
    assert r["accuracy"] * r["n"] == pytest.approx(round(r["accuracy"] * r["n"]))


def test_running_sums_span_partitions(spark):
    rng = random.Random(4)
    rows = [(g, v, rng.randrange(1, 5)) for g in "ab" for v in rng.sample(range(1000), 200)]
    got = running_sum(spark.createDataFrame(rows, "g string, v long, n long"), ["g"], "v", "n").collect()
    for r in got:
        assert r["up_to"] == sum(n for g, v, n in rows if g == r["g"] and v <= r["v"])


def test_teammates_leave_the_gallery(spark):
    from lodestone.plans.q_eval import identity_ranks

    sides = lambda rows: spark.createDataFrame(rows, "t int, player long, team int, vec array<double>")
    q = sides([(1, 1, 0, [1.0, 0.0]), (1, 2, 0, [0.0, 1.0]), (1, 3, 1, [1.0, 1.0]), (1, 9, 1, [float("nan"), 1.0])])
    t = sides([(1, 1, 0, [0.6, 0.8]), (1, 2, 0, [1.0, 0.1]), (1, 3, 1, [0.9, 0.2]), (1, 9, 1, [1.0, 1.0])])
    every = {r["player"]: r["place"] for r in identity_ranks(q, t, "t", "player").collect()}
    others = {r["player"]: r["place"] for r in identity_ranks(q, t, "t", "player", "team").collect()}
    assert every == {1: 4, 2: 4, 3: 3} and others == {1: 3, 2: 3, 3: 2}


@pytest.mark.parametrize("same_group", [False, True])
def test_top_k_equals_sorting(spark, same_group):
    df, x = vectors(spark, ties=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((x / np.where(n < 1e-12, 1, n)) @ (x / np.where(n < 1e-12, 1, n)).T, 12)
    want = {(q, c, p) for q in range(60) for p, c in enumerate(sorted((c for c in range(60) if c != q and (not same_group or c % 4 == q % 4)), key=lambda c: (-s[q, c], c))[:5], 1)}
    for block in (7, 1024):
        assert {(r["q"], r["c"], r["place"]) for r in R.top_k(df, df, 5, same_group, block=block).collect()} == want


def test_top_k_sorts_only_what_can_be_among_the_nearest(spark, monkeypatch):
    """Blocks after the first hand few of their rows to the sort: 64 queries against 4,000 items, four at most for each query and block."""
    rng, sorted_rows, sort = np.random.default_rng(4), [], np.lexsort
    items = [rng.normal(size=(1000, 16)) for _ in range(4)]
    asked = pd.DataFrame({"qb_id": [np.arange(64)], "qb_vec": [list(items[0][:64])], "qb_grp": [np.zeros(64)]})
    met = pd.DataFrame({"cb_id": [np.arange(1000) + 1000 * i for i in range(4)], "cb_vec": [list(x) for x in items], "cb_grp": [np.zeros(1000)] * 4})
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: sorted_rows.append(np.size(keys[0])) or sort(keys, axis))
    R.nearest_in_cell(asked, met, 2)
    assert len(sorted_rows) == 4 and max(sorted_rows) <= 64 * 8


def test_attr_lift_broadcasts_no_attributes(spark):
    from lodestone.plans.q_vectors import attr_lift

    plan = attr_lift(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin [query" in plan and all("p_partkey" in s or "query#" in s for s in sides)
