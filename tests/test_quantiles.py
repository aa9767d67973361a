"""Exact quantiles by selection, against Spark's own."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.quantiles import exact_quantiles

QS = [0.0, 0.025, 0.25, 1 / 3, 0.5, 0.666, 0.975, 1.0]


@pytest.mark.parametrize("small", [1, 5, 4096])
def test_as_percentile(spark, small):
    rng = random.Random(6)
    n = 900
    columns = {
        "uniform": [rng.uniform(-5, 5) for _ in range(n)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "holes": [None if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)], "tiny": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "one": [3.5 if i == 7 else None for i in range(n)], "same": [2.0] * n, "odd": [rng.choice([float("nan"), float("inf"), float("-inf"), 0.0, 1.5]) for _ in range(n)],
        "none": [None] * n, "close": [1.0 + i * 2.0**-50 for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = exact_quantiles(df, {c: QS for c in columns}, small)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, QS))).alias(c) for c in columns]).first()
    for c in columns:
        for x, y in zip(got[c], want[c] or [None] * len(QS)):
            assert x == y or x is not None and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-12)), (c, x, y)


def test_empty(spark):
    assert exact_quantiles(spark.range(0).selectExpr("cast(id as double) AS x"), {"x": [0.5]}) == {"x": [None]}


def test_a_step_hands_on_a_bounded_number_of_rows(spark):
    """Twenty thousand distinct values, four of them at most taken one by one."""
    df = spark.range(20_000).selectExpr("pow(id, 1.7) AS x")
    assert exact_quantiles(df, {"x": [0.5]}, small=4)["x"][0] == pytest.approx((9999**1.7 + 10_000**1.7) / 2)
