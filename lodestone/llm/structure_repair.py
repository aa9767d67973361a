"""Cheapest repair of conversations whose turns are missing, empty, repeated, cut off or in the wrong role.

A repaired conversation is an optional system message and then user and assistant in turn, ending with the assistant, or empty. Four
states say what stands so far: nothing, the system message, a user last, an assistant last. What a message may become, and at what cost,
depends on its symbol alone: its role's initial, and whether it has to go or is cut off. So a run of equal symbols is one matrix of
costs between states, in min-plus algebra, raised to the run's length by cached binary powers. Costs run from the end of a
conversation back to its start; the choices are then unrolled from the start, at each message the least letter that keeps the least cost.

Messages are ordered by a range partitioning, so a conversation of any size lies in segments of bounded size. A segment hands on one
matrix; the matrices of a conversation give what follows each segment, a segment unrolls its choices for each state that it may
begin in, and the segments' ends choose among them. No task holds the messages of a conversation together.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, stage

FAR = 1 << 50  # no way between two states
ROLES = "sua"  # initials with a place of their own, in the order of the states they lead to; others are class 3
MUST_GO = 8  # symbol of a message that has to be deleted; the others are 2 * class of the initial + (1 if cut off)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
END = (0, 2 * INSERT, INSERT, 0)  # from each state, by inserts, to a whole conversation
GIVEN = {0: 2, 1: 2, 3: 2, 2: 3}  # state after an inserted or re-roled message: a user's turn, or after a user the assistant's
NAMED = {2: "user", 3: "assistant"}
SPACE = r"[\x20\x09-\x0D]"


def kept(symbol: int, state: int) -> int | None:
    """The state after a message that is kept, None where its role can't stand."""
    initial = symbol // 2
    if symbol == MUST_GO or initial > 2 or initial == 0 and state != 0 or initial == 2 and state != 2 or initial == 1 and state == 2:
        return None
    return initial + 1


@functools.cache
def transition(symbol: int) -> np.ndarray:
    """Least cost from state to state over one message and the inserts before it."""
    inserts, edit = np.full((4, 4), FAR), np.full((4, 4), FAR)
    for s in range(4):
        t, paid = s, 0
        for _ in range(3):
            inserts[s, t] = min(inserts[s, t], paid)
            t, paid = GIVEN[t], paid + INSERT
        edit[s, s] = DELETE
        if symbol != MUST_GO:
            edit[s, GIVEN[s]] = REROLE + CUT_OFF * (symbol % 2)
            if (t := kept(symbol, s)) is not None:
                edit[s, t] = min(edit[s, t], KEEP + CUT_OFF * (symbol % 2))
    return joined(inserts, edit)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


@functools.cache
def power(symbol: int, bit: int) -> np.ndarray:
    """The transition of 2^bit messages of one symbol."""
    return transition(symbol) if bit == 0 else joined(power(symbol, bit - 1), power(symbol, bit - 1))


def before(runs: list[tuple[int, int]], after: np.ndarray) -> np.ndarray:
    """Costs from each state before the runs; ``after`` has them, by state, behind the runs (a column for each way to go on)."""
    for symbol, length in reversed(runs):
        bit = 0
        while length >> bit:
            if length >> bit & 1:
                after = joined(power(symbol, bit), after)
            bit += 1
    return after


@functools.lru_cache(maxsize=1 << 16)
def _back(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(joined(transition(symbol), np.array(after)[:, None])[:, 0].tolist())


@functools.lru_cache(maxsize=1 << 16)
def _step(symbol: int, now: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters for one message (inserts before it too), and the state after it, along a cheapest way."""
    paid = CUT_OFF * (symbol % 2)
    if DELETE + after[state] == now[state]:
        return "D", state
    if INSERT + now[GIVEN[state]] == now[state]:
        letters, end = _step(symbol, now, after, GIVEN[state])
        return "I" + letters, end
    goal = kept(symbol, state)
    if goal is not None and KEEP + paid + after[goal] == now[state]:
        return "K", goal
    return "R", GIVEN[state]


def unrolled(runs: list[tuple[int, int]], after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """Edits of a segment that begins in ``state``, and the state that it ends in."""
    ends = [tuple(after.tolist())]  # costs behind each run, from the last to the first
    for run in reversed(runs[1:]):
        ends.append(tuple(before([run], np.array(ends[-1])[:, None])[:, 0].tolist()))
    out = []
    for (symbol, length), behind in zip(runs, reversed(ends)):
        low = min(behind)  # only differences decide, and few of them occur
        costs = [tuple(x - low for x in behind)]
        for _ in range(length):
            now = _back(symbol, costs[-1])
            costs.append(now)
        for k in range(length, 0, -1):
            letters, state = _step(symbol, costs[k], costs[k - 1], state)
            out.append(letters)
    while last and END[state]:
        out.append("I")
        state = GIVEN[state]
    return "".join(out), state


def runs_of(packed: np.ndarray, copies: np.ndarray) -> list[tuple[int, int]]:
    """Runs (symbol, length) of messages; all copies of a message but the first have to go."""
    symbols, lengths = [], []
    for x, n in zip((packed // 4).tolist(), copies.tolist()):
        for symbol, length in ((x, 1), (MUST_GO, n - 1)):
            if length and symbols and symbols[-1] == symbol:
                lengths[-1] += length
            elif length:
                symbols.append(symbol)
                lengths.append(length)
    return list(zip(symbols, lengths))


def _illegal(first: np.ndarray, second: np.ndarray) -> int:
    """Neighbours whose classes are not system-user, user-assistant or assistant-user."""
    return int((~np.isin(first * 4 + second, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's matrix, its illegal neighbours and its first and last classes."""
    for batch in batches:
        rows = []
        for packed, copies in zip(_arrays(batch["packed"]), _arrays(batch["copies"])):
            matrix = before(runs_of(packed, copies), np.where(np.eye(4, dtype=bool), 0, FAR))
            kind = packed % 4
            rows.append((matrix.ravel().tolist(), _illegal(kind[:-1], kind[1:]) + int((copies - 1).sum()), int(kind[0]), int(kind[-1])))
        parts = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], *parts], names=["conv", "part", "matrix", "illegal", "head", "tail"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a conversation's segments in order, the costs behind each; the cost and the illegal neighbours of the whole."""
    kind = pa.list_(pa.struct([("part", pa.int64()), ("after", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())]))
    for batch in batches:
        rows = []
        for segments in batch["segments"].to_pylist():
            after, out = np.array(END), []
            illegal = sum(s["illegal"] for s in segments) + sum(_illegal(np.array([a["tail"]]), np.array([b["head"]])) for a, b in zip(segments, segments[1:]))
            for i, s in reversed(list(enumerate(segments))):
                out.append({"part": s["part"], "after": after.tolist(), "first": i == 0, "last": i == len(segments) - 1})
                after = joined(np.array(s["matrix"]).reshape(4, 4), after[:, None])[:, 0]
            rows.append((int(after[0]), illegal, out))
        parts = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), kind))]
        yield pa.RecordBatch.from_arrays([batch["conv"], *parts], names=["conv", "cost", "illegal", "segments"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's edits and last state for each state that it may begin in."""
    for batch in batches:
        rows = []
        for packed, copies, after, first, last in zip(_arrays(batch["packed"]), _arrays(batch["copies"]), _arrays(batch["after"]), batch["first"].to_pylist(), batch["last"].to_pylist()):
            runs = runs_of(packed, copies)
            rows.append(tuple(zip(*(unrolled(runs, after, s, last) for s in ([0] if first else range(4))))))
        parts = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 2, (pa.list_(pa.string()), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], *parts], names=["conv", "part", "edits", "ends"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's whole audit, and the state in which each of its segments begins."""
    kind = pa.list_(pa.struct([("part", pa.int64()), ("state", pa.int32())]))
    for batch in batches:
        rows = []
        for segments in batch["segments"].to_pylist():
            state, audit, begins = 0, [], []
            for s in segments:
                begins.append({"part": s["part"], "state": state})
                audit.append(s["edits"][state])
                state = s["ends"][state]
            rows.append(("".join(audit), begins))
        parts = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 2, (pa.string(), kind))]
        yield pa.RecordBatch.from_arrays([batch["conv"], *parts], names=["conv", "audit", "begins"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each message of the repaired conversation: its place, the message it comes from (none if inserted), a role if given anew."""
    for batch in batches:
        owner, place, source, role, edit = [], [], [], [], []
        columns = (batch[c].to_pylist() for c in ("begin", "edits", "state"))
        for i, (packed, copies, begin, edits, state) in enumerate(zip(_arrays(batch["packed"]), _arrays(batch["copies"]), *columns)):
            ends, row, seen = np.cumsum(copies).tolist(), 0, 0
            for k, letter in enumerate(edits):
                if letter in "IR":
                    state = GIVEN[state]
                elif letter == "K":
                    state = int(packed[row]) // 8 + 1
                if letter != "D":
                    owner.append(i)
                    place.append(k)
                    edit.append(letter)
                    source.append(None if letter == "I" else begin + row)
                    role.append(None if letter == "K" else NAMED[state])
                if letter != "I":
                    seen += 1
                    row += seen == ends[row]
        at = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["conv"].take(at), batch["part"].take(at), pa.array(place, pa.int64()), pa.array(edit, pa.string()), pa.array(source, pa.int64()), pa.array(role, pa.string())], names=["conv", "part", "place", "edit", "at", "given"])


@dataclass(frozen=True)
class Repair:
    """messages: conv, part, place, edit, role, text of the repaired conversations; order within one is (part, place). conversations: conv,
    gaps, blank, duplicate, truncated, illegal, cost, audit. ``conv`` is a struct with the field id, so that a null id is a key like others."""

    messages: DataFrame
    conversations: DataFrame


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Find the cheapest edits that make every conversation well-formed, and apply them.

    Messages are ordered by turn (nulls first), then role and text. Null roles and texts count as one space, null ids are one conversation.
    The first fault of a message counts: blank (no visible character), duplicate (role and text seen earlier in the conversation),
    truncated (last visible character not ``. ! ?``). Keep costs 0, re-role to user or assistant 2, delete 3 (blank and duplicate
    messages must go), insert an empty user or assistant message 2; a truncated message that stays adds 1. Of equally cheap repairs
    that with the least audit (initials of the edits, in order) is taken. Only a first character s, u or a of a role, as it is, has a
    place; an empty role has none. gaps counts missing turns between the least and the largest. Rows that repeat are copies.
    An empty table gives empty tables. Other columns are not read.
    """
    rows = messages.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    # Any number of messages of one conversation spread over the ranges; the number is a message's place among all.
    in_order = distinct.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    ordered = stage(in_order.withColumn("at", F.monotonically_increasing_id()), "ordered")

    blank, whole = ~F.col("text").rlike(rf"[^{SPACE[1:]}"), F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    told = ordered.select("conv", "turn", "at", "copies", kind.alias("kind"), blank.alias("blank"), (~whole).alias("cut"), "role", F.unhex(F.sha2("text", 256)).alias("same"))
    firsts = told.groupBy("conv", "role", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    known = told.drop("role", "same").join(firsts, "at", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    symbol = F.when(F.col("blank") | ~F.col("new"), MUST_GO).otherwise(F.col("kind") * 2 + F.col("cut").cast("int"))
    marked = stage(known.select("conv", "turn", "at", "copies", "blank", "new", "cut", F.shiftright("at", 33).alias("part"), (symbol * 4 + F.col("kind")).cast("int").alias("packed")), "marked")

    copies = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    faults = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        copies(F.when(F.col("blank"), F.col("copies"))).alias("blank"),
        copies(F.when(~F.col("blank"), F.col("copies") - F.col("new").cast("long"))).alias("duplicate"),
        copies(F.when(~F.col("blank") & F.col("new") & F.col("cut"), 1)).alias("truncated"),
    )
    # A segment is what of a conversation lies in one range, so no larger than a partition.
    listed = marked.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("at", "packed", "copies"))).alias("x"))
    segments = stage(listed.select("conv", "part", F.col("x")[0]["at"].alias("begin"), F.col("x.packed").alias("packed"), F.col("x.copies").alias("copies")), "segments")

    conv = f"conv {ordered.schema['conv'].dataType.simpleString()}"
    matrices = segments.mapInArrow(_summed, f"{conv}, part long, matrix array<long>, illegal long, head int, tail int")
    gathered = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "matrix", "illegal", "head", "tail"))).alias("segments"))
    followed = stage(gathered.mapInArrow(_followed, f"{conv}, cost long, illegal long, segments array<struct<part: long, after: array<long>, first: boolean, last: boolean>>"), "followed")
    behind = followed.select("conv", F.explode("segments").alias("s")).select("conv", "s.*")
    choices = stage(segments.join(behind, ["conv", "part"]).mapInArrow(_chosen, f"{conv}, part long, edits array<string>, ends array<int>"), "choices")
    chains = choices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "edits", "ends"))).alias("segments"))
    linked = stage(chains.mapInArrow(_linked, f"{conv}, audit string, begins array<struct<part: long, state: int>>"), "linked")
    begins = linked.select("conv", F.explode("begins").alias("b")).select("conv", "b.*")
    edits = segments.join(choices, ["conv", "part"]).join(begins, ["conv", "part"]).select("conv", "part", "begin", "packed", "copies", "state", F.col("edits")[F.col("state")].alias("edits"))
    placed = edits.mapInArrow(_placed, f"{conv}, part long, place long, edit string, at long, given string")
    texts = ordered.select("at", "role", "text")
    out = placed.join(texts, "at", "left").select("conv", "part", "place", "edit", F.coalesce("given", "role").alias("role"), F.when(F.col("edit") != "I", F.col("text")).otherwise("").alias("text"))
    # One table for each conversation; it is small beside the messages.
    whole_rows = stage(faults.join(followed.drop("segments"), "conv").join(linked.drop("begins"), "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "conversations")
    discard(marked)
    return Repair(out, whole_rows)


def digests(messages: DataFrame) -> DataFrame:
    """conv and sha256 of each repaired conversation's ``role:text`` lines, read as a stream: a task holds one batch and one hash's state,
    however long a conversation is (its bytes have to pass one after the other)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state = None, None
        for batch in batches:
            convs = batch["conv"].field(0)
            done, sums = [], []
            for i, (conv, role, text) in enumerate(zip(convs.to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist())):
                line = f"{role}:{text}".encode()
                if state is None or (conv,) != open_conv:
                    if state is not None:
                        done.append(open_conv[0])
                        sums.append(state.hexdigest())
                    open_conv, state = (conv,), hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield made(done, sums, convs.type)
        if state is not None:
            yield made([open_conv[0]], [state.hexdigest()], convs.type)

    def made(done: list, sums: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(done, kind)], ["id"]), pa.array(sums, pa.string())], names=["conv", "sha256"])

    ordered = messages.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text")
    return ordered.mapInArrow(stream, f"conv {messages.schema['conv'].dataType.simpleString()}, sha256 string")


def damaged(messages: DataFrame, key: Column) -> DataFrame:
    """Messages with faults chosen by ``key`` (0 to 19): 0 drops a message, 1 empties it, 2 removes its ``. ! ?``, 3 repeats it, 4 makes it the user's."""
    text = F.when(key == 1, "").when(key == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(key == 4, "user").otherwise(F.col("role"))
    once = messages.where(key != 0)
    return once.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(key == 3, 2).otherwise(1))).alias("_")).drop("_")
