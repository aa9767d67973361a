"""Statistics of all pairs, from cells that never hand on a pair."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.operators import ranking as R


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((90, 6))
    x[10:20] = x[10]  # ties
    return x, spark.createDataFrame([(int(i), v.tolist(), int(i % 4 == 0)) for i, v in enumerate(x)], "id long, vec array<double>, grp int")


def cosines(x):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    return np.round(u @ u.T, 12)


@pytest.mark.parametrize("block, small, parts", [(7, 3, 16), (1000, 4096, 4096), (20, 1, 2)])
def test_quantiles_of_all_pairs(items, block, small, parts):
    x, df = items
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(cosines(x)[np.triu_indices(90, 1)], qs)
    assert np.allclose(R.pair_quantiles(df, qs, block, parts, small), want, atol=1e-11)


def test_few(items):
    _, df = items
    assert R.pair_quantiles(df.where("id < 1"), [0.5]) == [None]
    assert R.pair_quantiles(df.where("id in (10, 11)"), [0.0, 0.5]) == pytest.approx([1.0, 1.0])


@pytest.mark.parametrize("block", [5, 1000])
def test_standing(spark, items, block, monkeypatch):
    monkeypatch.setattr(R, "SUPER", 2)
    x, df = items
    sims, group = cosines(x), np.arange(90) % 4 == 0
    pairs = [(k, a, b) for k, (a, b) in enumerate([(0, 4), (0, 8), (0, 1), (10, 11), (10, 50), (33, 2), (33, 2)])]
    rows = spark.createDataFrame([(k, a, float(sims[a, b])) for k, a, b in pairs], "pair long, x long, s double")
    got = {r["pair"]: r for r in R.standing_in_group(df, rows, block).collect()}
    for k, a, b in pairs:
        others = [c for c in range(90) if c != a and group[c] == group[a]]
        assert got[k]["n"] == len(others) and got[k]["below"] == sum(sims[a, c] < sims[a, b] for c in others)
        assert got[k]["total"] == pytest.approx(sum(sims[a, c] for c in others))
    assert len(got) == len(pairs)
