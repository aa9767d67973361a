"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, stage


def _star(edges: DataFrame, label: str, large: bool) -> DataFrame:
    """One step: link each node's larger (large star) or smaller (small star) neighbours to its smallest one."""
    if large:
        near = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = near.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        moved = near.join(least, "src").where("dst > src").select(F.col("low").alias("src"), "dst")
    else:
        down = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))  # v < u
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        moved = down.join(least, "u").select(F.col("low").alias("src"), F.col("v").alias("dst")).unionByName(
            least.select(F.col("low").alias("src"), F.col("u").alias("dst"))
        )
    return stage(moved.where("src <> dst").distinct(), label)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))"), F.sum(F.xxhash64("dst", "src") % 1000003)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Edges are undirected; loops and null ends are left out. Only joins and partial aggregates by node are used, so a node
    with very many edges is a skewed join side and no group is gathered. Each round is written and read again; rounds grow
    with the logarithm of the longest path.
    """
    low, high = F.least(src, dst), F.greatest(src, dst)
    now = stage(edges.where(f"{src} is not null and {dst} is not null and {src} <> {dst}").select(low.alias("src"), high.alias("dst")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before, old = state, now
        large = _star(now, "largestar", True)
        now = _star(large, "smallstar", False)
        discard(old, large)
    return now.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(
        now.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    )
