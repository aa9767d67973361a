"""All pairs of vectors: parts, groups, and what a task holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from lodestone.operators import ranking as R


@pytest.mark.parametrize("same_group", [False, True])
@pytest.mark.parametrize(("side", "block"), [(7, 3), (1 << 14, 1024)])
def test_every_ordered_pair_once(spark, same_group, side, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist(), None if i == 9 else i % 3 if i < 50 else 7) for i in range(90)] + [(3, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp int")
    got = sorted(tuple(r) for r in R.all_pairs(df, same_group, side, block).collect())
    unit = [(i, np.array(v) / np.linalg.norm(v), g) for i, v, g in rows]
    want = sorted((a, b, float(u @ v)) for a, u, g in unit for b, v, h in unit if a != b and (not same_group or g is not None and g == h))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    by_pair = lambda rows: sorted((a, b, round(s, 9) + 0.0) for a, b, s in rows)
    assert np.allclose([r[2] for r in by_pair(got)], [r[2] for r in by_pair(want)])


def test_a_task_hands_on_small_pieces():
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"scope": 0, "i": 0, "j": 1, "part": [0] * 300 + [1] * 200, "id": range(500), "vec": list(rng.normal(size=(500, 4)))})
    pieces = list(R.pairs_in_cells(iter([frame[:250], frame[250:]]), pairs=1000))
    assert sum(map(len, pieces)) == 2 * 300 * 200 and max(map(len, pieces)) <= 1000


def test_a_large_group_is_spread_and_vectors_are_copied_once_for_each_part(spark):
    df = spark.range(2000).selectExpr("id", "array(double(id), 1.0D) AS vec", "1 AS grp")
    for same_group in (False, True):
        found = R.all_pairs(df, same_group, side=500, block=500)
        assert "Join" in found._jdf.queryExecution().executedPlan().toString()
        assert found.rdd.getNumPartitions() == 40 and found.count() == 2000 * 1999


def test_vectors_that_single_precision_holds_travel_so(spark):
    rows = [(0, [0.5, 2.0], 1), (1, [0.1, 2.0], 1), (2, [0.0, 0.0], 1), (3, [float(np.float32(0.1)), 1.0], 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp int")
    sent = R.packed(df)
    assert sent.schema["short"].dataType.simpleString() == "array<float>"
    assert {r["id"]: (r["short"] is None, r["vec"] is None) for r in sent.collect()} == {0: (False, True), 1: (True, False), 2: (False, True), 3: (False, True)}
    got = {(r["q"], r["c"]): r["sim"] for r in R.all_pairs(df).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for i, v, _ in rows}
    assert got == {(a, b): pytest.approx(float(unit[a] @ unit[b]), abs=2e-12) for a in unit for b in unit if a != b}
