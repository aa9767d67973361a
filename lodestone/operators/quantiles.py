"""Exact quantiles of columns of any size, by distributed selection.

Values are counted by range, first by sign and binary order of magnitude, then by a thousand equal parts of whichever range holds a wanted
rank, until such a range is small or holds one value. Every step is a partial aggregate with a bounded number of rows; no task and no
driver ever holds more than ``small`` values of a column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1024


def _magnitude(v: Column) -> Column:
    """A number that grows with the value: by sign and power of two; infinities and NaN have their own, NaN last."""
    power = F.floor(F.log2(F.abs(v))).cast("int")
    finite = F.when(v == 0, 0).when(v > 0, 2000 + power).otherwise(-2000 - power)
    return F.when(F.isnan(v), 5000).when(v == float("inf"), 4000).when(v == float("-inf"), -4000).otherwise(finite)


Bin = tuple[float, int, float, float]  # order, values, least, largest
Open = tuple[int, float, float, int, int, list[int]]  # column, least, largest, values before, values, ranks wanted


def selected(first: Mapping[int, Sequence[Bin]], wanted: Mapping[int, Sequence[float]], recount: Callable[[list[Open]], Mapping[int, Sequence[Bin]]]) -> dict[int, list[float | None]]:
    """Quantiles of each column from its bins: bins of one value settle the ranks in them, the others are counted anew in finer bins."""
    known: dict[tuple[int, int], float] = {}
    places: dict[int, list[float]] = {}

    def settled(c: int, ranks: list[int], base: int, bins: Sequence[Bin]) -> list[Open]:
        still = []
        for _, n, low, high in sorted(bins):
            inside = [r for r in ranks if base <= r < base + n]
            if inside and (low == high or math.isnan(low)):
                known.update({(c, r): low for r in inside})
            elif inside:
                still.append((c, low, high, base, n, inside))
            base += n
        return still

    still = []
    for c, qs in wanted.items():
        if n := sum(b[1] for b in first.get(c, ())):
            places[c] = [q * (n - 1) for q in qs]
            still += settled(c, sorted({f(p) for p in places[c] for f in (math.floor, math.ceil)}), 0, first[c])
    while still:
        finer = recount(still)
        still = [x for i, (c, _, _, base, _, ranks) in enumerate(still) for x in settled(c, ranks, base, finer[i])]

    def at(c: int, place: float) -> float:
        low, high = known[c, math.floor(place)], known[c, math.ceil(place)]
        return low if low == high or place == math.floor(place) else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return {c: [at(c, p) for p in places[c]] if c in places else [None] * len(qs) for c, qs in wanted.items()}


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], small: int = 4096) -> dict[str, list[float | None]]:
    """For each column its quantiles, as ``percentile`` gives them: interpolated between the two nearest ranks of its non-null values,
    NaN above all others; None without values. ``df`` is read once for each step, four times or so: stage it if it is costly."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(wanted)])).alias("x")).select("x.*").where("v is not null")
    v, counts = F.col("v"), [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]

    def recount(still: list[Open]) -> dict[int, list[Bin]]:
        which, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (c, low, high, _, n, _) in enumerate(still):
            here = (F.col("c") == c) & (v >= low) & (v <= high)
            which = F.when(here, i).otherwise(which)
            # A small range is told value by value: its rows are then grouped by value below.
            part = F.when(here, F.lit(-1) if n <= small else F.least(F.lit(PARTS - 1), F.floor((v - low) / (high - low) * PARTS).cast("int"))).otherwise(part)
        counted = rows.select("v", which.alias("i"), part.alias("part")).where("i is not null").groupBy("i", "part", F.when(F.col("part") < 0, v).alias("one")).agg(*counts).collect()
        return {i: [(r["low"], r["n"], r["low"], r["high"]) for r in counted if r["i"] == i] for i in range(len(still))}

    first: dict[int, list[Bin]] = {}
    for r in rows.groupBy("c", _magnitude(v).alias("bin")).agg(*counts).collect():
        first.setdefault(r["c"], []).append((r["bin"], r["n"], r["low"], r["high"]))
    found = selected(first, dict(enumerate(wanted.values())), recount)
    return {name: found[i] for i, name in enumerate(wanted)}
