"""Exact dedup by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes. Each round splits every open group by its next digit: a group that becomes a
singleton, or whose texts end within the digit, is settled; the others go on with the bytes that follow. Texts of one
settled group are equal byte for byte, so equality needs no digest. Digits widen by ``growth`` a round, so the number of
rounds grows with the logarithm of the longest text that has a copy, and from the second round on only rows that still
share a whole prefix move.

Each round counts its cells with a partial aggregate and joins the counts back, so a cell that holds a third of all rows
is a skewed join side, which Spark splits; no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, stage


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), first: int = 64, growth: int = 8) -> DataFrame:
    """One row per input row: ``id_col``, the ``carry`` columns, keep_id, group_size and kept.

    Of equal texts the row with the largest id stays. Null text counts as empty, a null id as the smallest; of rows that
    repeat both id and text exactly one is kept. Other columns of ``docs`` are not read, so their names cannot clash.
    An empty table gives an empty result. ``carry`` columns must be of types that can be grouped on.
    """
    return _groups(docs, id_col, text_col, carry, first, growth)[0]


def _groups(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], first: int = 64, growth: int = 8) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``exact_groups``, and the staged tables that it reads."""
    rest = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    open_rows = docs.select(
        F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"), F.lit(-1).cast("long").alias("cell"),
        F.monotonically_increasing_id().alias("tag"), rest.alias("rest"),
    )
    settled, staged, width, round_no = [], [], first, 0
    while round_no == 0 or not open_rows.isEmpty():
        rows = open_rows.withColumn("digit", F.substring("rest", 1, width))
        cells = rows.groupBy("cell", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.min("tag").alias("next_cell"))
        split = rows.join(cells, ["cell", "digit"])
        done = (F.col("n") == 1) | (F.length("digit") < width)
        settled.append(split.where(done).select("id", "carry", "top", "n"))
        open_rows = stage(
            split.where(~done).select("id", "carry", F.col("next_cell").alias("cell"), "tag", F.expr(f"substring(rest, {width + 1})").alias("rest")),
            f"radix{round_no}",
        )
        staged.append(open_rows)
        width, round_no = width * growth, round_no + 1
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    # Rows alike in id and text are interchangeable: count them, then number the copies, so that one of them is kept.
    copies = found.groupBy("id", "carry", "top", "n").agg(F.count(F.lit(1)).alias("m"))
    numbered = copies.select("*", F.explode(F.expr("sequence(1L, m)")).alias("copy"))
    out = numbered.select(
        F.col("id").alias(id_col), *[F.col("carry")[c].alias(c) for c in carry], F.col("top").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("top")) & (F.col("copy") == 1)).alias("kept"),
    )
    return out, staged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text, that with the largest id.

    Ids may repeat with other texts; such rows are told apart by the whole text's SHA-256 when the kept rows are looked
    up again (the grouping itself compares bytes).
    """
    key = "__exact_key"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    groups, staged = _groups(keyed, id_col, text_col, (key,), **options)
    dropped = groups.where("not kept")
    # What goes is smaller than what stays. A copy with the very id and text of a kept row is met below.
    lost = stage(dropped.groupBy(id_col, key, F.col("keep_id").eqNullSafe(F.col(id_col)).alias("__exact_twin")).count(), "dropped")
    discard(*staged)
    twins, losers = lost.where("__exact_twin"), lost.where("not __exact_twin")
    on = lambda a, b: a[id_col].eqNullSafe(b[id_col]) & (a[key] == b[key])
    stay = keyed.join(losers, on(keyed, losers), "left_anti")
    if twins.isEmpty():
        return stay.drop(key)
    single = stay.join(twins, on(stay, twins), "left_anti")
    again = stay.join(twins, on(stay, twins), "left_semi").dropDuplicates([id_col, key])
    return single.unionByName(again).drop(key)
