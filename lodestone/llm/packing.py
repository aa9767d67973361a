"""Packing of token sequences into fixed windows by bounded-space best fit.

Each task keeps a fixed number of open windows. A document's whole windows are cut off first; what remains is placed in
the open window where it fits best; when it fits in none and no more may be opened, the fullest is emitted. Windows still
open at a task's end are merged: rounds of groups of tasks, each group placing windows into windows best-fit decreasing and
passing on a fixed number of the emptiest, until one group is left. A round moves a row for each open window, no tokens.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoded
from lodestone.llm.words import give_back, sliced
from lodestone.plans.staging import stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text that are held as Python strings at a time.
_RUN = 1 << 20


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens: (free, id), sorted by free space."""

    def __init__(self, size: int, most: int, ids: Iterator[int]):
        self.size, self.most, self.ids, self.open = size, most, ids, []

    def place(self, length: int) -> tuple[int, int]:
        """The window and offset where so many tokens (0 < length <= size) go."""
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest is emitted
            free, window = self.size, next(self.ids)
        if free > length:
            bisect.insort(self.open, (free - length, window))
        return window, self.size - free


def _id_source(low: int) -> Iterator[int]:
    while True:
        yield low
        low += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "used"])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, open_windows: int = 64, fan_in: int = 32) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id`` (null text: empty, so ``end_id`` alone). Each id lies in exactly one piece,
    the pieces of a sequence follow each other without gaps from offset 0, and a sequence holds at most ``size`` ids.
    Sequence ids are unique and otherwise without meaning. Repeated rows are packed each for itself; a null id stays null;
    other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession

    def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        part = TaskContext.get().partitionId()
        ids = _id_source(part << 32)
        windows = OpenWindows(size, open_windows, ids)
        # A slice at a time, so that no second copy of a batch of texts is held.
        for batch in sliced(batches, _RUN):
            rows: list[tuple] = []
            for doc_id, tokens in zip(batch["id"].to_pylist(), encoded(tokenizer, batch["text"].to_pylist())):
                tokens = np.append(tokens, np.int32(end_id)).astype("<u4")
                n = len(tokens)
                for start in range(0, n, size):
                    piece = tokens[start : start + size]
                    window, offset = (next(ids), 0) if len(piece) == size else windows.place(len(piece))
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), n, window, offset, part, None))
            yield _batch(rows)
        # The windows left open, as rows without a document.
        yield _batch([(None, 0, 0, 0, 0, window, 0, part, size - free) for free, window in windows.open])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = stage(rows.mapInArrow(first_fit, PIECES + ", part long, used long"), "packed")
    pieces = packed.where("used is null").drop("part", "used")
    left = packed.where("used is not null").select("part", F.col("sequence_id").alias("window"), "used")
    moves = merge_open(left, size, open_windows, fan_in)
    if moves is None:
        return pieces
    moved = pieces.join(moves, pieces["sequence_id"] == moves["window"], "left")
    return moved.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("target", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def merge_open(left: DataFrame, size: int, keep_open: int, fan_in: int) -> DataFrame | None:
    """Where each open window's content goes (window, target, base), or None if none moves."""

    def refit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["used", "window"], ascending=[False, True])
        fits = OpenWindows(size, len(group), iter(group["window"].tolist()))
        placed = []
        for window, used in zip(group["window"], group["used"]):
            # A new window takes the next unused id; ids come largest first, so it is its own or one that has moved.
            placed.append((window, used, *fits.place(int(used))))
        out = pd.DataFrame(placed, columns=["window", "used", "target", "base"])
        total = out.groupby("target")["used"].transform("sum")
        emptiest = set(out.assign(total=total).drop_duplicates("target").nsmallest(keep_open, ["total", "target"])["target"])
        return out.assign(group=int(key[0]), total=total, stays=~out["target"].isin(emptiest))[["group", "window", "target", "base", "total", "stays"]]

    groups = left.select((F.col("part") / fan_in).cast("long").alias("group"), "window", "used")
    where_to: DataFrame | None = None
    round_no = 0
    while True:
        step = stage(groups.groupBy("group").applyInPandas(refit, "group long, window long, target long, base long, total long, stays boolean"), f"merge{round_no}")
        hop = step.select("window", "target", "base")
        if where_to is None:
            where_to = hop
        else:
            later = hop.select(F.col("window").alias("w"), F.col("target").alias("t"), F.col("base").alias("b"))
            where_to = where_to.join(later, F.col("target") == F.col("w"), "left").select(
                "window", F.coalesce("t", "target").alias("target"), (F.col("base") + F.coalesce("b", F.lit(0))).alias("base")
            )
        seen = step.agg(F.max("group").alias("top")).first()["top"]
        if not seen:  # one group, or no open windows at all
            return where_to
        groups = step.where("not stays").groupBy("group", "target").agg(F.first("total").alias("used")).select(
            (F.col("group") / fan_in).cast("long").alias("group"), F.col("target").alias("window"), "used"
        )
        round_no += 1
