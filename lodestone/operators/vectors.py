"""Building entity vectors: discovery, imputation, normalisation, pruning, shrinkage, fusion."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import l2, uniform
from lodestone.operators.quantiles import exact_quantiles
from lodestone.plans.numbering import running_sum


def discovered(df: DataFrame, prefix: str | None = None, keys: tuple[str, ...] = ()) -> list[str]:
    """Vector columns: those of the prefix in order of their number, or all that are no keys, in the table's order."""
    if prefix is None:
        return [c for c in df.columns if c not in keys]
    return sorted((c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)), key=lambda c: int(c[len(prefix) :]))


def wide_to_vector(df: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """(key, vec) from discovered columns."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in discovered(df, prefix, (key,))]).alias("vec"))


def vector_to_wide(df: DataFrame, key: str, size: int, prefix: str = "f") -> DataFrame:
    return df.select(key, *[F.col("vec")[i].alias(f"{prefix}{i}") for i in range(size)])


def long(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """One row for each dimension: keys, pos, value."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "value"))


def imputed(df: DataFrame, policy: Mapping[str, float | str]) -> DataFrame:
    """Nulls and NaNs filled column by column: by a constant, or by the column's median. An absent column becomes its constant;
    an absent median column, or one with no values, stays null."""
    real = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in policy if c in df.columns}
    wanted = [c for c in real if policy[c] == "median"]
    found = exact_quantiles(df.select(*[real[c].alias(c) for c in wanted]), {c: [0.5] for c in wanted}) if wanted else {}
    fill = {c: (found[c][0] if c in found else None) if how == "median" else float(how) for c, how in policy.items()}
    return df.withColumns({c: F.coalesce(real.get(c, F.lit(None)), F.lit(x).cast("double")) for c, x in fill.items()})


def attached(entities: DataFrame, vectors: DataFrame, key: str, missing: Column | None = None) -> DataFrame:
    """All entities with ``vec`` from vectors (key, vec); without one, ``missing`` (null if None)."""
    found = entities.join(vectors.select(key, "vec"), key, "left")
    return found if missing is None else found.withColumn("vec", F.coalesce("vec", missing))


def filled_by_global_mean(entities: DataFrame, vectors: DataFrame, key: str, size: int) -> DataFrame:
    """As ``attached``, where missing vectors hold the mean over all cells of all vectors."""
    mean = vectors.select(F.explode("vec").alias("x")).agg(F.avg("x").alias("__mean"))
    return attached(entities, vectors, key).join(F.broadcast(mean)).withColumn("vec", F.coalesce("vec", F.array_repeat("__mean", size))).drop("__mean")


def column_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: mean, std (of the population) and n, by dimension in arrays."""
    by = df.select(F.posexplode(vec).alias("pos", "value")).groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("value").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s", "n")))
    return by.agg(ordered.alias("d")).select(F.col("d.m").alias("mean"), F.col("d.s").alias("std"), F.col("d.n").alias("n"))


def zscored(df: DataFrame, stats: DataFrame) -> DataFrame:
    """vec minus mean over std; a std under 1e-8 counts as 1."""
    z = F.zip_with(F.zip_with("vec", "mean", lambda x, m: x - m), "std", lambda x, s: x / F.when(s < 1e-8, 1.0).otherwise(s))
    return df.join(F.broadcast(stats.select("mean", "std"))).withColumn("vec", z).drop("mean", "std")


def pruned(df: DataFrame, stats: DataFrame, least: float = 0.02) -> DataFrame:
    """Only dimensions with a std above ``least``."""
    keep = F.filter(F.sequence(F.lit(0), F.size("std") - 1), lambda i: F.col("std")[i] > least)
    return df.join(F.broadcast(stats.select("std"))).withColumn("vec", F.transform(keep, lambda i: F.col("vec")[i])).drop("std")


def fused(*blocks: tuple[Column | str, float]) -> Column:
    """Blocks scaled to length 1, weighted, concatenated, and scaled to length 1."""

    def weighted(v: Column | str, weight: float) -> Column:
        return F.transform(l2(v), lambda x: x * F.lit(weight))

    return l2(F.concat(*[weighted(v, w) for v, w in blocks]))


def truncated(v: Column | str, size: int) -> Column:
    return l2(F.slice(v, 1, size))


def shrunk(df: DataFrame, group: str, n: str, train: Column, k: float = 5.0) -> DataFrame:
    """Empirical-Bayes shrinkage of vec to its group's mean over training rows, (n x + k mean) / (n + k); null for a group that
    has no training row."""
    means = df.where(train).select(group, F.posexplode("vec").alias("pos", "v")).groupBy(group, "pos").agg(F.avg("v").alias("m"))
    prior = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("d")).select(group, F.col("d.m").alias("__prior"))
    mixed = F.zip_with("vec", "__prior", lambda x, m: (F.col(n) * x + k * m) / (F.col(n) + k))
    return df.join(prior, group, "left").withColumn("vec", mixed).drop("__prior")


def mean_vectors(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, vec) with the mean by dimension."""
    by = df.select(*keys, F.posexplode("vec").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("m"))
    return by.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("d")).select(*keys, F.col("d.m").alias("vec"))


def random_vectors(ids: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(id, vec): standard normal draws from the MD5 of seed, id and dimension, scaled to length 1."""
    draw = lambda i, part: uniform(F.lit(seed), F.lit(part), "id", i)
    normal = lambda i: F.sqrt(-2 * F.log(1 - draw(i, "r"))) * F.cos(2 * 3.141592653589793 * draw(i, "a"))
    return ids.select("id", l2(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), normal)).alias("vec"))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def percentile_ranks(rows: DataFrame, features: list[str], *by: str) -> DataFrame:
    """Percentile (0 to 100, average of ties) of each value among its feature's, long: id, by, feature, value, pct.

    Values are counted first, and the running sums over distinct values are taken by ranges of them, so that a continuous feature
    isn't gathered in one task; nulls have no rank.
    """
    flat = rows.unpivot(["id", *by], features, "feature", "value").where("value is not null")
    counts = flat.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(counts, [*by, "feature"], "value", "n")
    total = placed.groupBy(*by, "feature").agg(F.sum("n").alias("total"))
    places = placed.join(total, [*by, "feature"]).select(*by, "feature", "value", (100 * (F.col("up_to") - F.col("n") + (F.col("n") + 1) / 2) / F.col("total")).alias("pct"))
    return flat.join(places, [*by, "feature", "value"])
