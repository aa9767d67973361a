"""Tests on per-query metrics: bootstraps by query and by cluster, cluster t, step-down correction, equivalence, power.

Bootstraps read their units once (``operators/resampling.py``): the block bootstrap one (sum, n) row for each cluster, however many
queries it has. Draws are the same at every run, at any partitioning, and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.distributions import t_figures, t_p_value
from lodestone.operators.resampling import replicate_means
from lodestone.plans.numbering import numbered, running_sum


def indexed(units: DataFrame, key: str, *keys: str) -> DataFrame:
    """``units`` with idx from 0 in order of ``key``, within ``keys`` or overall, without gathering a group's rows in one task."""
    if not keys:
        return numbered(units, key)
    placed = running_sum(units.withColumn("__one", F.lit(1)), list(keys), key, "__one", "__up_to")
    return placed.withColumn("idx", (F.col("__up_to") - 1).cast("long")).drop("__one", "__up_to")


def _quantile(values: Column, q: float) -> Column:
    """Between the two nearest of sorted values, in proportion."""
    place = q * (F.size(values) - 1)
    low = F.element_at(values, F.floor(place).cast("int") + 1)
    return low + (place - F.floor(place)) * (F.element_at(values, F.ceil(place).cast("int") + 1) - low)


def interval(means: DataFrame, *keys: str) -> DataFrame:
    """(keys, low, high, p_raw, p) of replicates' ``means``, an array: the 95 % percentile interval, and two-sided p without and with the
    usual floor."""
    put = means.select(*keys, F.array_sort("means").alias("means"))
    below, above, n = F.size(F.filter("means", lambda x: x <= 0)), F.size(F.filter("means", lambda x: x >= 0)), F.size("means")
    least = F.least(below, above)
    return put.select(
        *keys, _quantile(F.col("means"), 0.025).alias("low"), _quantile(F.col("means"), 0.975).alias("high"),
        F.least(F.lit(1.0), 2 * least / n).alias("p_raw"), F.least(F.lit(1.0), 2 * (least + 1) / (n + 1)).alias("p"),
    )


def paired_bootstrap(diffs: DataFrame, replicates: int = 10_000, seed: str = "pb", *keys: str) -> DataFrame:
    """By query: (keys, mean, low, high, p_raw, p) of ``value`` over (keys, q, value)."""
    units = indexed(diffs.select(*keys, "q", F.col("value").alias("total"), F.lit(1).alias("n")), "q", *keys)
    means = diffs.groupBy(*keys).agg(F.avg("value").alias("mean"))
    found = interval(replicate_means(units, replicates, seed, *keys), *keys)
    return means.join(found, list(keys)) if keys else means.join(F.broadcast(found))


def cluster_sums(values: DataFrame, *keys: str) -> DataFrame:
    return values.groupBy(*keys, "cluster").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def block_bootstrap(values: DataFrame, replicates: int = 10_000, seed: str = "bb", *keys: str) -> DataFrame:
    """By cluster: (keys, mean, low, high, p_raw, p) of ``value`` over (keys, cluster, value); the mean is pooled over queries."""
    units = indexed(cluster_sums(values, *keys), "cluster", *keys)
    means = values.groupBy(*keys).agg(F.avg("value").alias("mean"))
    found = interval(replicate_means(units, replicates, seed, *keys), *keys)
    return means.join(found, list(keys)) if keys else means.join(F.broadcast(found))


def cluster_t(values: DataFrame, *keys: str) -> DataFrame:
    """One-sample t on cluster means: (keys, mean, se, clusters, t, p, mde, power). One cluster gives nulls."""
    means = values.groupBy(*keys, "cluster").agg(F.avg("value").alias("m"))
    row = means.groupBy(*keys).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("se"), F.count("m").alias("clusters"))
    row = row.withColumn("t", F.try_divide("mean", "se"))
    df = F.col("clusters") - 1
    full = row.withColumn("p", t_p_value(F.col("t"), df)).withColumn("f", t_figures(F.abs("mean"), F.col("se"), df))
    return full.select(*keys, "mean", "se", "clusters", "t", "p", "f.mde", "f.power")


def holm(tests: DataFrame, name: str = "name", p: str = "p", alpha: float = 0.05, *keys: str) -> DataFrame:
    """Tests with threshold and ``rejected``: step-down from the least p, stopping at the first failure. A family is small."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = w.orderBy(p, name)
    placed = tests.withColumn("i", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(w))
    step = placed.withColumn("threshold", alpha / (F.col("m") - F.col("i") + 1))
    ok = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("rejected", ok == 1).drop("i", "m")


def equivalent(low: Column, high: Column, margin: float = 0.005) -> Column:
    """Whether an interval lies inside the margin on both sides of 0."""
    return (low > -margin) & (high < margin)
