"""Bootstrap replicates in one pass over the units.

How often each of k units is drawn in a replicate is multinomial. Here a replicate's k draws are split down a fixed tree of ranges of unit
numbers: the share that goes to the left half of a range is binomial, told by a number that hashes the seed, the node of the tree and the
replicate. So any task can find the draws of the units that it holds, for all replicates at once, without a row for a draw and without
knowing the other units; it adds up its units' values times their draws and hands on a few arrays of sums. The result doesn't depend on
how the units are partitioned.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import shuffle_width

#: Above so many draws a binomial is told by its normal limit, whose error is far below a replicate's own.
LARGE = 1 << 16
NODE, REPLICATE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
UNITS, CHUNK = 128, 512  # units split at a time; replicates in a row of sums


def seed_number(seed: str) -> int:
    return int(hashlib.md5(seed.encode()).hexdigest()[:16], 16)


def uniforms(seed: int, nodes: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each node (rows) and replicate (columns)."""
    x = (nodes.astype(np.uint64) * np.uint64(NODE))[:, None] + (replicates.astype(np.uint64) * np.uint64(REPLICATE) + np.uint64(seed))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@functools.cache
def _log_factorials() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, LARGE + 1)))])


def binomial(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least count whose cumulated probability exceeds u, of m draws at p each."""
    if p in (0.0, 1.0):
        return m * int(p)
    out = np.zeros_like(m)
    large = m > LARGE
    if large.any():
        n = m[large].astype(float)
        out[large] = np.clip(np.rint(n * p + np.sqrt(n * p * (1 - p)) * np.array([NormalDist().inv_cdf(max(x, 1e-17)) for x in u[large].tolist()])), 0, n).astype(m.dtype)
    small = np.flatnonzero(~large)
    if len(small):
        sizes, which = np.unique(m[small], return_inverse=True)
        spread = 9 * np.sqrt(sizes * p * (1 - p)) + 12
        low = np.maximum(0, np.floor(sizes * p - spread)).astype(np.int64)
        width = np.minimum(sizes, np.ceil(sizes * p + spread)).astype(np.int64) - low + 1
        row = np.repeat(np.arange(len(sizes)), width)
        begin = np.cumsum(width) - width
        c, n, f = np.arange(len(row)) - begin[row] + low[row], sizes[row], _log_factorials()
        chance = np.exp(f[n] - f[c] - f[n - c] + c * np.log(p) + (n - c) * np.log1p(-p))
        sums = np.cumsum(chance)
        upto = np.minimum(sums - (sums[begin] - chance[begin])[row], 1.0)
        # All distributions in one sorted array: row + cumulated probability.
        found = np.searchsorted(row + upto, which + u[small], "right")
        out[small] = np.minimum(low[which] + found - begin[which], sizes[which])
    return out


class Tree:
    """Draws of k units in each replicate. Consecutive calls with rising units share their way down: the nodes of the last call are kept
    (two or so on a level above the units asked for), so that a node near the root, whose binomials are the costliest, is split once."""

    def __init__(self, k: int, replicates: np.ndarray, seed: int):
        self.k, self.replicates, self.seed = k, replicates, seed
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # level: nodes, draws that go left

    def draws(self, idx: np.ndarray) -> np.ndarray:
        """How often units ``idx`` (sorted, of 0 .. k-1) are drawn in each replicate: a row for each unit."""
        k, width = self.k, len(self.replicates)
        first = lambda j, level: (j * k) >> level  # noqa: E731  where node j of a level begins
        nodes, counts = np.zeros(1, np.int64), np.full((1, width), k, np.int64)
        for level in range((k - 1).bit_length()):
            left = np.empty_like(counts)
            old, known = self.kept.get(level, (nodes[:0], counts[:0]))
            at = np.minimum(np.searchsorted(old, nodes), max(0, len(old) - 1))
            seen = old[at] == nodes if len(old) else np.zeros(len(nodes), bool)
            if seen.any():
                left[seen] = known[at[seen]]
            fresh = np.flatnonzero(~seen)
            if len(fresh):
                mine = nodes[fresh]
                mid, begin, end = (first(2 * mine + i, level + 1) for i in (1, 0, 2))
                u = uniforms(self.seed, (1 << level) + mine, self.replicates)
                size, part = end - begin, mid - begin
                for s, a in set(zip(size.tolist(), part.tolist())):
                    rows = np.flatnonzero((size == s) & (part == a))
                    left[fresh[rows]] = binomial(counts[fresh[rows]].ravel(), a / s, u[rows].ravel()).reshape(-1, width)
            self.kept[level] = nodes[-2:], left[-2:].copy()
            children = np.unique((((idx + 1) << (level + 1)) - 1) // k)
            parent = np.searchsorted(nodes, children >> 1)
            counts = np.where((children & 1)[:, None] == 0, left[parent], counts[parent] - left[parent])
            nodes = children
        return counts


def draws(k: int, idx: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often units ``idx`` (sorted, of 0 .. k-1) are drawn in each replicate: a row for each unit."""
    return Tree(k, replicates, seed).draws(idx)


def replicate_means(units: DataFrame, replicates: int, seed: str, *keys: str) -> DataFrame:
    """(keys, means): for each group of units (keys, idx from 0, total, n) the pooled mean of each replicate, as an array.

    Each row of ``units`` is drawn with replacement as often as its group has rows. Rows are sorted by ranges of (keys, idx), so a large
    group is spread over tasks and neighbours share their way down the tree. Groups are small beside that: one array each.
    """
    number, chunks = seed_number(seed), -(-replicates // CHUNK)
    every = np.arange(replicates)
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    sized = units.join(sizes, list(keys)) if keys else units.join(F.broadcast(sizes))
    ordered = sized.select(*keys, "k", "idx", F.col("total").cast("double"), F.col("n").cast("double")).repartitionByRange(shuffle_width(units.sparkSession), *keys, "idx").sortWithinPartitions(*keys, "idx")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, n, tree = None, None, None, None

        def rows() -> pd.DataFrame:
            parts = [(total[i : i + CHUNK].tolist(), n[i : i + CHUNK].tolist()) for i in range(0, replicates, CHUNK)]
            head = {c: [v] * len(parts) for c, v in zip(keys, now)}
            return pd.DataFrame({**head, "chunk": range(len(parts)), "total": [p[0] for p in parts], "n": [p[1] for p in parts]})

        for batch in batches:
            groups = batch.groupby(list(keys), sort=False, dropna=False) if keys else [((), batch)]
            for key, part in groups:
                if now is None or tuple(key) != now:
                    if now is not None:
                        yield rows()
                    now, total, n = tuple(key), np.zeros(replicates), np.zeros(replicates)
                    tree = Tree(int(part["k"].iloc[0]), every, number)
                idx = part["idx"].to_numpy()
                values, weights = part["total"].to_numpy(), part["n"].to_numpy()
                for i in range(0, len(idx), UNITS):
                    drawn = tree.draws(idx[i : i + UNITS])
                    total += values[i : i + UNITS] @ drawn
                    n += weights[i : i + UNITS] @ drawn
        if now is not None:
            yield rows()

    kinds = ", ".join(f"{c} {units.schema[c].dataType.simpleString()}" for c in keys)
    partial = ordered.mapInPandas(sums, f"{kinds + ', ' if keys else ''}chunk int, total array<double>, n array<double>")

    def added(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[:1].copy()
        total, n = np.sum(part["total"].tolist(), axis=0), np.sum(part["n"].tolist(), axis=0)
        # Twelve places: sums that cancel are zero in whatever order they were added up.
        out["means"] = [np.round(total / n, 12).tolist()]
        return out[[*keys, "chunk", "means"]]

    means = partial.groupBy(*keys, "chunk").applyInPandas(added, f"{kinds + ', ' if keys else ''}chunk int, means array<double>")
    return means.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "means"))), lambda x: x["means"])).alias("means"))


def tree_sql(name: str, units: str, by: str, replicates: int, seed: str, levels: int = 10) -> str:
    """CTEs that give ``name`` (by, rep, mean) from ``units`` (by, idx, total, n, k) for groups of at most 2^levels units."""
    mix = "xor({x}, {x} >> {r})"
    product = "(({x})::UHUGEINT * {c} % 18446744073709551616)::UBIGINT"
    wrap = f"((node::UHUGEINT * {NODE} + rep::UHUGEINT * {REPLICATE} + {seed_number(seed)}) % 18446744073709551616)::UBIGINT"
    out = f""", {name}_k AS (SELECT DISTINCT k::BIGINT AS k FROM {units}), {name}_r AS (SELECT unnest(range({replicates})) AS rep),
 {name}_sp AS (SELECT DISTINCT k, (((2 * j + 2) * k) >> (l + 1)) - ((2 * j * k) >> (l + 1)) AS s, (((2 * j + 1) * k) >> (l + 1)) - ((2 * j * k) >> (l + 1)) AS a FROM {name}_k, (SELECT unnest(range({levels})) AS l), (SELECT unnest(range({1 << (levels - 1)})) AS j) WHERE j < (1 << l)),
 {name}_sq AS (SELECT s, a, max(k) AS k FROM {name}_sp WHERE a > 0 AND a < s GROUP BY s, a),
 {name}_cd AS (SELECT s, a, m, c, sum(p) OVER (PARTITION BY s, a, m ORDER BY c) - p AS low FROM (SELECT s, a, m, c, exp(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1) + c * ln(a / s::DOUBLE) + (m - c) * ln(1 - a / s::DOUBLE)) AS p
   FROM {name}_sq, unnest(range(k + 1)) AS u(m), unnest(range(m + 1)) AS v(c) WHERE (s = k AND m = k OR s < k) AND abs(c - m * a / s::DOUBLE) <= 9 * sqrt(m * a * (s - a) / s::DOUBLE / s) + 13 AND m * 1.0 <= k * s / k + 10 * sqrt(k * s / k) + 14)),
 {name}_l0 AS (SELECT k, rep, 0::BIGINT AS j, k AS m FROM {name}_k, {name}_r)"""
    for level in range(levels):
        out += f""",
 {name}_g{level} AS (SELECT k, rep, j, m, (((2 * j + 2) * k) >> {level + 1}) - ((2 * j * k) >> {level + 1}) AS s, (((2 * j + 1) * k) >> {level + 1}) - ((2 * j * k) >> {level + 1}) AS a, (j + {1 << level})::UBIGINT AS node FROM {name}_l{level}),
 {name}_u{level} AS (SELECT *, {product.format(x=mix.format(x=wrap, r=30), c=0xBF58476D1CE4E5B9)} AS x1 FROM {name}_g{level}), {name}_v{level} AS (SELECT *, {product.format(x=mix.format(x='x1', r=27), c=0x94D049BB133111EB)} AS x2 FROM {name}_u{level}),
 {name}_w{level} AS (SELECT k, rep, j, m, s, a, ({mix.format(x='x2', r=31)} >> 11)::DOUBLE * power(2.0::DOUBLE, -53) AS u FROM {name}_v{level}),
 {name}_c{level} AS (SELECT k, rep, j, m, s, a, 0::BIGINT AS c FROM {name}_w{level} WHERE a = 0 UNION ALL SELECT k, rep, j, m, s, a, m FROM {name}_w{level} WHERE a = s
   UNION ALL SELECT w.k, w.rep, w.j, w.m, w.s, w.a, d.c FROM {name}_w{level} w ASOF JOIN {name}_cd d ON w.s = d.s AND w.a = d.a AND w.m = d.m AND w.u >= d.low WHERE w.a > 0 AND w.a < w.s),
 {name}_l{level + 1} AS (SELECT k, rep, 2 * j AS j, c AS m FROM {name}_c{level} WHERE a > 0 UNION ALL SELECT k, rep, 2 * j + 1, m - c FROM {name}_c{level} WHERE a < s)"""
    return out + f""",
 {name} AS (SELECT {by}, rep, round(sum(un.total * l.m) / sum(un.n * l.m), 12) AS mean FROM {units} un JOIN {name}_l{levels} l ON l.k = un.k AND (l.j * un.k) >> {levels} = un.idx AND l.m > 0 GROUP BY {by}, rep)"""
