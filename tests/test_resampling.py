"""Replicates from a tree of binomial splits: against a plain descent, exact distributions, and at any partitioning."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import inference as I
from lodestone.operators import resampling as R
from lodestone.operators.resampling import binomial, draws, replicate_means, seed_number, uniforms


def split(k, m, p, u):
    """Least count whose cumulated probability exceeds u, one by one."""
    sums = 0.0
    for c in range(m + 1):
        sums += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if sums > u:
            return c
    return m


def descended(k, replicate, seed):
    """Draws of all k units of one replicate, by recursion."""
    out = [0] * k

    def go(level, j, m):
        low, mid, high = ((x * k) >> (level + 1) for x in (2 * j, 2 * j + 1, 2 * j + 2))
        if high - low == 1 and level >= (k - 1).bit_length():
            out[low] = m
            return
        if high == low:
            return
        p = (mid - low) / (high - low)
        u = uniforms(seed, np.array([(1 << level) + j]), np.array([replicate]))[0, 0]
        left = m if p == 1 else 0 if p == 0 else split(k, m, p, u)
        go(level + 1, 2 * j, left)
        go(level + 1, 2 * j + 1, m - left)

    if k == 1:
        return [1]
    go(0, 0, k)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5, 16, 23])
def test_tree(k):
    seed, reps = seed_number("x"), np.arange(40)
    got = draws(k, np.arange(k), reps, seed)
    assert [got[:, r].tolist() for r in reps] == [descended(k, r, seed) for r in reps]
    some = np.arange(k)[::2]
    assert (draws(k, some, reps[7:9], seed) == got[some][:, 7:9]).all()


def test_draws_are_multinomial():
    k, reps = 37, np.arange(20_000)
    d = draws(k, np.arange(k), reps, seed_number("m"))
    assert (d.sum(0) == k).all()
    assert np.abs(d.mean(1) - 1).max() < 0.03 and np.abs(d.var(1) - (1 - 1 / k)).max() < 0.05
    assert abs(np.cov(d[3], d[30])[0, 1] + 1 / k) < 0.03
    share = np.bincount(d[5], minlength=4)[:4] / len(reps)
    assert np.abs(share - [math.comb(k, c) * (1 / k) ** c * (1 - 1 / k) ** (k - c) for c in range(4)]).max() < 0.015


def test_binomial():
    u = np.linspace(0, 1, 997, endpoint=False)[1:]
    for m, p in ((1, 0.5), (9, 1 / 3), (300, 0.497), (2000, 0.5)):
        got = binomial(np.full(len(u), m), p, u)
        sums = np.cumsum([math.exp(math.lgamma(m + 1) - math.lgamma(c + 1) - math.lgamma(m - c + 1) + c * math.log(p) + (m - c) * math.log1p(-p)) for c in range(m + 1)])
        assert (got == np.minimum(np.searchsorted(sums, u, "right"), m)).all()
    large = binomial(np.full(len(u), 10**8), 0.5, u)
    assert abs(large.mean() - 5e7) < 500 and 4000 < large.std() < 6000
    assert binomial(np.array([5]), 0.0, u[:1])[0] == 0 and binomial(np.array([5]), 1.0, u[:1])[0] == 5


def test_any_partitioning_and_many_units(spark):
    units = spark.range(3000).selectExpr("id % 3 AS g", "id div 3 AS idx", "sin(id) AS total", "1 + id % 4 AS n")
    want = None
    for parts in (1, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["g"]: r["means"] for r in replicate_means(units.repartition(parts), 1100, "s", "g").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        want = want or got
        assert got == want and all(len(m) == 1100 for m in got.values())
    rows = units.where("g = 1").orderBy("idx").toPandas()
    d = draws(1000, np.arange(1000), np.arange(1100), seed_number("s"))
    assert np.allclose((rows.total.values @ d) / (rows.n.values @ d), want[1], atol=1e-11)
    assert replicate_means(units.where("g = 1").drop("g"), 1100, "s").first()["means"] == want[1]


def test_interval_is_about_normal(spark):
    values = spark.range(400).select(F.col("id").alias("q"), F.expr("cast(pmod(id * 7919, 1000) as double) / 1000").alias("value"))
    found, plain = I.paired_bootstrap(values, 2000, "n").first(), values.agg(F.avg("value").alias("m"), (F.stddev_pop("value") / 20).alias("se")).first()
    assert abs(found["low"] - plain["m"] + 1.96 * plain["se"]) < 0.15 * plain["se"] and abs(found["high"] - plain["m"] - 1.96 * plain["se"]) < 0.15 * plain["se"]


def test_pieces_share_their_way_down(monkeypatch):
    """Two hundred successive pieces of a large group split the nodes above them once, and draw what each would by itself."""
    k, reps, seed, split = 3_000_000, np.arange(40), seed_number("w"), []
    tree, alone = R.Tree(k, reps, seed), np.arange(128)
    first = draws(k, alone + 5000, reps, seed)
    plain = R.binomial
    monkeypatch.setattr(R, "binomial", lambda m, p, u: split.append(len(m)) or plain(m, p, u))
    assert (tree.draws(alone + 5000) == first).all()
    for i in range(1, 200):
        split.clear()
        tree.draws(alone + 5000 + 128 * i)
        assert sum(split) <= 40 * 3 * 128
    assert sum(split) < 40 * (2 * 128 + 22)
    monkeypatch.undo()
    assert (tree.draws(alone + 200_000) == draws(k, alone + 200_000, reps, seed)).all()


def test_sql_of_enough_levels_draws_as_the_query(spark):
    """The SQL's tree has a leaf for each of 2^levels units; with more units it needs another level, the query none."""
    import duckdb

    con = duckdb.connect()
    for k, levels, equal in ((8, 3, True), (9, 3, False), (9, 4, True)):
        units = spark.range(k).selectExpr("'a' AS g", "id AS idx", "sin(id) AS total", "1 + id % 3 AS n", f"{k}L AS k")
        got = replicate_means(units.drop("k"), 50, "s", "g").first()["means"]
        frame = units.toPandas()  # noqa: F841  read by DuckDB
        sql = "WITH un AS (SELECT * FROM frame)" + R.tree_sql("mn", "un", "g", 50, "s", levels) + " SELECT mean FROM mn ORDER BY rep"
        want = [m for (m,) in con.execute(sql).fetchall()]
        assert (len(want) == 50 and np.allclose(got, want, atol=1e-9)) == equal
