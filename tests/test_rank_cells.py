"""Ranks within a cell: right for items too close for single precision, and in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lodestone.operators import ranking as R


def _cell(vectors, ids, groups, r_of):
    items = pd.DataFrame([{"cb_id": ids, "cb_grp": groups, "cb_vec": list(vectors)}])
    sims = [np.round(vectors[x] @ vectors[i], 12) for i, x in enumerate(r_of)]
    asks = pd.DataFrame([{"eb_q": ids, "eb_qvec": list(vectors), "eb_qgrp": groups, "eb_r": [ids[x] for x in r_of], "eb_rgrp": [groups[x] for x in r_of], "eb_sim": sims}])
    return asks, items


def test_items_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(3)
    n = 90
    base = rng.normal(size=(6, 16))
    vectors = base[np.arange(n) % 6] + rng.choice([0.0, 1e-9, 1e-6], size=(n, 1)) * rng.normal(size=(n, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids, groups = rng.permutation(n), rng.integers(0, 3, n)
    asks, items = _cell(vectors, ids, groups, [np.array([(i + 6) % n, (i + 1) % n]) for i in range(n)])
    got = R.ranks_in_cell(asks, items)
    sims = np.round(vectors @ vectors.T, 12)
    where = {x: i for i, x in enumerate(ids.tolist())}
    for q, r, rank_all, rank_group in got.itertuples(index=False):
        i, j = where[q], where[r]
        order = sorted((x for x in range(n) if x != i), key=lambda x: (-sims[i, x], ids[x]))
        within = sorted(range(n), key=lambda x: (x == i or groups[x] != groups[i], 0 if x == i or groups[x] != groups[i] else -sims[i, x], ids[x]))
        assert (rank_all, rank_group) == (order.index(j), within.index(j))


def test_a_cell_of_the_grid_is_bounded(spark):
    blocks = spark.range(64).select("id", R.F.col("id").cast("int").alias("eb"))
    left, right = R._grid(blocks, 64, "eb", blocks.withColumnRenamed("eb", "cb"), 64, "cb")
    assert max(r["count"] for side in (left, right) for r in side.groupBy("cell").count().collect()) <= 16
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1024, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    asks, items = _cell(vectors, np.arange(1024), np.arange(1024) % 10, [np.array([(i + 1) % 1024, (i + 5) % 1024]) for i in range(1024)])
    tracemalloc.start()
    R.ranks_in_cell(asks, items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 32e6


def _expected(vectors, ids, groups, q, r):
    sims = np.round(vectors @ vectors.T, 12)
    where = {x: i for i, x in enumerate(ids.tolist())}
    i, j = where[q], where[r]
    order = sorted((x for x in range(len(ids)) if x != i), key=lambda x: (-sims[i, x], ids[x]))
    within = sorted(range(len(ids)), key=lambda x: (x == i or groups[x] != groups[i], 0 if x == i or groups[x] != groups[i] else -sims[i, x], ids[x]))
    return order.index(j), within.index(j)


def test_zero_vectors_are_counted_without_products(monkeypatch):
    rng = np.random.default_rng(6)
    n = 120
    vectors = rng.normal(size=(n, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[rng.permutation(n)[:40]] = 0.0
    ids, groups = rng.permutation(n), rng.integers(0, 3, n)
    asks, items = _cell(vectors, ids, groups, [np.unique([(i + 7) % n, (i + 1) % n, (i + 50) % n]) for i in range(n)])
    plain, again = np.einsum, []
    monkeypatch.setattr(R.np, "einsum", lambda how, a, b: again.append(len(a)) or plain(how, a, b))
    got = R.ranks_in_cell(asks, items)
    monkeypatch.undo()
    assert sum(again) < 20  # every pair with a zero vector was computed again before
    for q, r, rank_all, rank_group in got.itertuples(index=False):
        assert (rank_all, rank_group) == _expected(vectors, ids, groups, q, r)


def test_many_equal_vectors_are_compared_in_pieces():
    n = 1500
    vectors = np.tile(np.ones(64) / 8, (n, 1))
    ids, groups = np.arange(n), np.arange(n) % 2
    asks, items = _cell(vectors, ids, groups, [np.array([(i + 1) % n]) for i in range(n)])
    tracemalloc.start()
    got = R.ranks_in_cell(asks, items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200e6 and got["rank_all"].tolist() == [i for i in range(n - 1)] + [0]


def test_ones():
    rng = np.random.default_rng(7)
    for width in (0, 5, 8, 1023, 2040, 2048, 5003):
        matrix = rng.random((13, width)) < 0.9
        assert R._ones(matrix).tolist() == matrix.sum(1).tolist() and R._ones(matrix[::2, 1:]).tolist() == matrix[::2, 1:].sum(1).tolist()


@pytest.mark.parametrize("mated", [False, True])
@pytest.mark.parametrize("many", [0, 8, 10**6])
def test_places_of_targets_with_many_ties(monkeypatch, mated, many):
    """Maps with few events, whose cosines are mostly alike, and scattered ones; in parts small enough that some count as a whole."""
    for name, value in (("LEAF", 16), ("BLOCK", 32), ("MANY", many)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(8)
    n = 150
    for kind in ("maps", "scattered", "zeros"):
        q, t = (rng.integers(0, 2, (n, 12)).astype(float) if kind == "maps" else rng.uniform(0.5, 1, (n, 3)) for _ in "qt")
        if kind == "zeros":
            q[::5], t[::7] = 0.0, 0.0
        q, t = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, t))
        ids, mates = rng.permutation(n), rng.integers(0, 3, n) if mated else np.full(n, -1)
        stars = np.round((q * t).sum(1), 12)
        cut = lambda x: [x[:40], x[40:]]
        asked = pd.DataFrame({"lb_id": cut(ids), "lb_mate": cut(mates), "lb_s": cut(stars), "lb_vec": cut(list(q)), "lb_g": cut([0] * n)})
        items = pd.DataFrame({"rb_id": cut(ids), "rb_mate": cut(mates if mated else mates - 1), "rb_vec": cut(list(t))})
        got = R.places_in_cell(asked, items)
        sims = np.round(q @ t.T, 12)
        want = [sum((sims[i, j], -ids[j]) > (stars[i], -ids[i]) for j in range(n) if j != i and not (mated and mates[j] == mates[i])) for i in range(n)]
        assert got["id"].tolist() == ids.tolist() and got["before"].tolist() == want


def test_short_vectors_meet_in_fewer_cells(spark, monkeypatch):
    monkeypatch.setattr(R, "SUPER", 4)
    df = spark.range(256).selectExpr("struct(1 AS a) AS g", "id", "array(1D, 2D) AS vec")
    cells = lambda values: R.met_in_groups(df, df, ["id"], ["id", "vec"], lambda a, b: pd.DataFrame({"n": [len(a)]}), "n long", 4, values).count()
    assert cells(0) == 16**2 and cells(1 << 20) == 4**2 and cells(2 * 4 * 8) == 8**2


@pytest.mark.parametrize("name", ["submission_report", "masked_pool_map"])
def test_ranks_are_counted_once_for_both_scopes(spark, monkeypatch, name):
    from lodestone.plans import q_eval
    from lodestone.sources import files
    from tests.conftest import SF

    plans, write = [], files.write_report
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(files, "write_report", lambda df, path: (note(df), write(df, path))[1])
    found = getattr(q_eval, name)(spark, SF)
    if not plans:
        note(found)
    assert plans[0].count("FlatMapCoGroupsInPandas") == 1
