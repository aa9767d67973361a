"""Steps whose cost a finding showed to grow faster than their input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import events as E
from lodestone.operators import models as M
from lodestone.operators.encoders import encoded, heatmap_encoder


def test_hulls_of_many_players_and_of_a_large_one(spark):
    rng = np.random.default_rng(1)
    rows = [(int(p), float(x), float(y)) for p in range(300) for x, y in rng.integers(0, 20, (1 + p % 7, 2))] + [(999, float(x), float(y)) for x, y in rng.normal(size=(3000, 2))]
    df = spark.createDataFrame(rows, "player long, x0 double, y0 double").repartition(3)
    found = E.hull_areas(df, 1.0, 1.0)
    points: dict = {}
    for p, x, y in rows:
        points.setdefault(p, []).append((x, y))
    assert {r["player"]: r["hull_share"] for r in found.collect()} == pytest.approx({p: E.area(E.hull(np.array(xy))) for p, xy in points.items()})
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no frame for a player


def test_items_travel_as_they_are_where_sums_are_longer(spark):
    rng = random.Random(2)
    rows = [(p, rng.random() * 105, rng.random() * 68) for p in range(40) for _ in range(1 + (200 if p == 3 else p % 3))]
    df = spark.createDataFrame(rows, "p long, x double, y double").repartition(2)
    heat = heatmap_encoder(12, 8)
    got = {r["p"]: r for r in encoded(df, ["p"], ["x", "y"], heat).collect()}
    for p in range(40):
        own = np.array([r[1:] for r in rows if r[0] == p])
        assert got[p]["events"] == len(own) and got[p]["vec"] == pytest.approx(heat.each(own).sum(0) / len(own))
    plan = encoded(df, ["p"], ["x", "y"], heat)._jdf.queryExecution().executedPlan().toString()
    assert "cells" in plan


def test_sparse_factors_equal_dense_ones(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.random((30, 20)) * (rng.random((30, 20)) < 0.3), "b": rng.random((25, 20)) * (rng.random((25, 20)) < 0.4)}
    for m in x.values():
        m[:, 0] += 0.1
    sparse = spark.createDataFrame([(i, k, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for k, m in x.items() for i, r in enumerate(m)], "id long, kind string, at array<int>, value array<double>")
    h = M.fit_sparse_factors(sparse, 20, 3, ["a", "b", "c"], rounds=3)
    weights = {(r["kind"], r["id"]): r["vec"] for r in M.sparse_factor_weights(sparse, h).collect()}
    for kind, m in x.items():
        dense = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>")
        want = M.fit_factors(dense, 3, rounds=3)
        assert h[kind] == pytest.approx(want)
        for r in M.factor_weights(dense, want).collect():
            assert weights[kind, r["id"]] == pytest.approx(r["vec"])


def test_sparse_networks_are_settled_in_few_rounds(spark, monkeypatch):
    """2,000 rings of three: after a first round of 100 sources all others go in one."""
    labels, plain = [], E.stage
    monkeypatch.setattr(E, "stage", lambda df, label: labels.append(label) or plain(df, label))
    rows = spark.range(6000).selectExpr("1L AS game", "id AS src", "id div 3 * 3 + (id + 1) % 3 AS dst", "1 AS n")
    got = E.betweenness(rows, sources=100)
    assert labels.count("credits") == 2 and got.count() == 6000 and got.agg(F.max("betweenness")).first()[0] == pytest.approx(1 / (5999 * 5998))


def test_tf_idf_cuts_texts_after_they_are_put_together(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (1, "A d"), (4, " ")], "id long, text string")
    rows = [sorted(tuple(r) for r in M.tf_idf(docs, "id", "text", most).collect()) for most in (10, 1)]
    assert [r[:2] for r in rows[0]] == [(1, "a"), (1, "b"), (1, "d"), (2, "b"), (2, "c")] and rows[0] == rows[1]
    plan = M.tf_idf(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 2 and "REPARTITION_BY_COL" in plan


def test_encoders_go_one_after_the_other(spark, monkeypatch):
    """One encoder's profiles are removed before the next encoder's are written."""
    from lodestone.plans import q_pairs as P
    from tests.conftest import SF

    held, most, stage, discard = set(), [], P.stage, P.discard

    def staged(df, label):
        out = stage(df, label)
        if label == "profiles":
            held.add(out._staged_path)
            most.append(len(held))
        return out

    monkeypatch.setattr(P, "stage", staged)
    monkeypatch.setattr(P, "discard", lambda *frames: (held.difference_update(f._staged_path for f in frames), discard(*frames)))
    found = P.leakage_encoders(spark, SF).collect()
    assert most == [1, 1, 1] and not held and {r["encoder"] for r in found} == {"mean", "heatmap", "factors"}
