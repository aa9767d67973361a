"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as named
users. Each rendered message is a row: its text, the span it takes in the rendered conversation, and the span inside it that
the speaker is trained on (the mask). So a conversation of any length is rendered without gathering it: positions come from
sums by blocks of turns, and from sums of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotate_perspectives(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",), start: str = "<|im_start|>", end: str = "<|im_end|>", block: int = 256) -> DataFrame:
    """One row per message and perspective: conv_id, perspective, turn, position, header, rendered, char_start, char_end,
    is_target, mask_start, mask_end.

    Participants are the distinct roles of a conversation but for ``narrators``, which every perspective shows under their own
    role; a conversation without participants has no rendering. Null roles count as the participant "unknown", null texts
    as empty. Messages are ordered by turn (nulls first), then role and text; rows that repeat are rendered each for itself.
    char_start to char_end is the message's span in the whole rendering, mask_start to mask_end the part of it that the
    assistant is trained on: its text and the end mark; empty for others. Other columns are not read.
    """
    # Keys that may be null are structs: these are equal when their fields are both null, and serve plain equality joins, so
    # that the window below stands on the join's shuffle.
    rows = messages.select(
        F.struct(F.col(conv_col).alias("conv_id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    speakers = rows.where(~F.col("role").isin(*narrators)).select("conv", F.col("role").alias("perspective")).distinct()
    shown = rows.join(speakers, "conv")
    is_target = F.col("role") == F.col("perspective")
    name = F.when(is_target, F.lit("assistant")).when(F.col("role").isin(*narrators), F.col("role")).otherwise(F.concat(F.lit("user name="), "role"))
    made = shown.select(
        "conv", "perspective", F.struct(F.floor(F.col("turn") / block).alias("block")).alias("part"), "turn", "role", "text",
        is_target.alias("is_target"), F.concat(F.lit(start), name, F.lit("\n")).alias("header"),
    ).withColumn("size", (F.length("header") + F.length("text") + F.lit(len(end) + 1)).cast("long"))
    ends = made.groupBy("conv", "perspective", "part").agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("conv", "perspective").orderBy(F.col("part.block").asc_nulls_first())
    before = ends.select(
        "conv", "perspective", "part", (F.sum("chars").over(up_to) - F.col("chars")).alias("chars_before"), (F.sum("n").over(up_to) - F.col("n")).alias("n_before"),
    )
    placed = made.join(before, ["conv", "perspective", "part"])
    within = Window.partitionBy("conv", "perspective", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    stop = F.col("chars_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.select("*", stop.alias("char_end"), (F.col("n_before") + F.row_number().over(within) - 1).alias("position"))
    begin = F.col("char_end") - F.col("size")
    return out.select(
        "conv.conv_id", "perspective", "turn", "position", "header", F.concat("header", "text", F.lit(end + "\n")).alias("rendered"), begin.alias("char_start"), "char_end", "is_target",
        F.when(F.col("is_target"), begin + F.length("header")).otherwise(begin).alias("mask_start"),
        F.when(F.col("is_target"), F.col("char_end") - 1).otherwise(begin).alias("mask_end"),
    )
