"""Joins of names by edit distance, without comparing all with all.

A name is cut into one part more than edits are allowed, so that a name within that distance has one part as it is, at a place shifted
by no more than the edits before it (and leaving no more than those behind it). An inverted table of (length, part, text) proposes pairs,
the edit distance decides.

A part that many names have, such as a common beginning, would propose them all. Names that meet through such a part are proposed by what
they become with so many characters left out instead: two names within that distance have one of these in common, and how many names have
one is bounded by the alphabet, whatever the number of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, stage

# Staged names are many rows in small files, which Spark would take for small tables: every join of names is by shuffle (``hint("merge")``).

def _parts(names: DataFrame, edits: int) -> DataFrame:
    """(name, size, part, text): each name's own parts, of about equal length."""
    each = names.select("name", F.length("name").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("part"))
    begin = f"part * (size div {edits + 1}) + greatest(0, part - {edits + 1} + size % {edits + 1})"
    width = f"size div {edits + 1} + if(part >= {edits + 1} - size % {edits + 1}, 1, 0)"
    return each.select("name", "size", "part", F.expr(f"substring(name, cast({begin} + 1 as int), cast({width} as int))").alias("text"))


def _probes(names: DataFrame, edits: int) -> DataFrame:
    """(name, size, part, text): where parts of names of a length within the edits would stand in this one."""
    sizes = names.select("name", F.explode(F.sequence(F.greatest(F.lit(0), F.length("name") - edits), F.length("name") + edits)).alias("size"))
    each = sizes.select("name", "size", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("part"))
    begin = f"part * (size div {edits + 1}) + greatest(0, part - {edits + 1} + size % {edits + 1})"
    width = f"size div {edits + 1} + if(part >= {edits + 1} - size % {edits + 1}, 1, 0)"
    longer = "length(name) - size"
    placed = each.selectExpr("name", "size", "part", f"cast({begin} as int) AS begin", f"cast({width} as int) AS width", f"explode(sequence(cast(-(({edits} - ({longer})) div 2) as int), cast(({edits} + ({longer})) div 2 as int))) AS shift")
    inside = placed.where("begin + shift >= 0 and begin + shift + width <= length(name)")
    return inside.selectExpr("name", "size", "part", "substring(name, begin + shift + 1, width) AS text").distinct()


def _shortened(names: DataFrame, edits: int) -> DataFrame:
    """(name, less): each name with up to ``edits`` characters left out."""
    forms = F.array("name")
    for _ in range(edits):
        fewer = F.flatten(F.transform(forms, lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))).otherwise(F.array(x))))
        forms = F.array_distinct(F.concat(forms, fewer))
    return names.select("name", F.explode(forms).alias("less"))


def pairs_within(left: DataFrame, right: DataFrame, edits: int, frequent: int = 64) -> DataFrame:
    """(name, known, d): every pair of a ``name`` of the left and a ``name`` of the right at an edit distance of at most ``edits``.

    Null names match nothing; names that repeat count once. ``frequent`` names that share a part are no longer proposed through it but
    by shortened forms; either way every pair is found. An empty side gives an empty result.
    """
    left, right = (side.select("name").where("name is not null").distinct() for side in (left, right))
    if edits == 0:
        return left.join(right.withColumn("known", F.col("name")).hint("merge"), "name").select("name", "known", F.lit(0).alias("d"))
    key = ["size", "part", "text"]
    own, asked = stage(_parts(right, edits).withColumnRenamed("name", "known"), "parts"), stage(_probes(left, edits), "probes")
    # Both sides of a part count: as many on one side and a few on the other are as many pairs as they are names.
    crowded = own.groupBy(*key).count().where(F.col("count") > frequent).select(*key).hint("merge")
    proposed = asked.join(own.join(crowded, key, "left_anti").hint("merge"), key).select("name", "known")
    some_left = asked.join(crowded, key, "left_semi").select("name").distinct()
    some_right = own.join(crowded, key, "left_semi").select(F.col("known").alias("name")).distinct()
    also = _shortened(some_left, edits).join(_shortened(some_right, edits).withColumnRenamed("name", "known").hint("merge"), "less").select("name", "known")
    found = stage(proposed.unionByName(also).where(F.levenshtein("name", "known", edits) >= 0).distinct().withColumn("d", F.levenshtein("name", "known")), "close")
    discard(own, asked)
    return found


def closest(left: DataFrame, right: DataFrame, edits: int = 2, frequent: int = 64) -> DataFrame:
    """(name, known, d): for each name of the left all names of the right at its least distance, if that is at most ``edits``.

    Distances are tried in turn, so that only names without a closer match go on to the costlier ones.
    """
    rest, found = left.select("name").where("name is not null").distinct(), None
    for d in range(edits + 1):
        at = pairs_within(rest, right, d, frequent)
        found = at if found is None else found.unionByName(at)
        if d < edits:
            rest = stage(rest.join(at.select("name").distinct().hint("merge"), "name", "left_anti"), "unmatched")
    return found
