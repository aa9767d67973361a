"""Language-model scoring with a log-frequency Bloom filter.

Words, and pairs of successive words, are counted over the training texts. A count c is kept as its level 1 + floor(log_b c):
the filter holds the pair (n-gram, i) for every i up to its level, so probing i = 1, 2, ... until one is missing gives the
level back, never too small and seldom too large. All n-grams are held, those seen once too, and the filter has the size that
their levels ask for: its number of segments follows from the number of training tokens, and each segment is sized and filled
by the task that adds up the counts of its n-grams. Nothing depends on a cluster's settings.

The probability of a word after another is (c(v w) + k P(w)) / (c(v) + k), where P is the smoothed unigram probability; these sum
to one over all words.

A filter of at most ``most_bits`` is broadcast. A larger one stays a table: the probes of a block of texts go to the segments by
a shuffle, the levels come back by another, and the scores are the same.

Exact counts, for the unigram base score, don't come from the filter: those of the frequent words (a bounded number of bounded
length) are broadcast, all others are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import mixed, sliced, split_words, string_hashes
from lodestone.plans.staging import discard, release, stage

END = ""  # the token that ends a text and precedes the first; no word is empty
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    """log_base: b of the levels. keys: bits set for an entry, within one 64-bit word. load: bits for an entry. share: training tokens
    for a segment, about. most_bits: the largest filter that is broadcast. prior: k of the probabilities. frequent, longest: bounds
    of the words that are broadcast with their exact counts. ranges: most rows of probes from one block of texts (a power of two)."""

    log_base: float = 1.5
    keys: int = 4
    load: int = 11
    share: int = 1 << 18
    most_bits: int = 1 << 27
    prior: float = 8.0
    frequent: int = 200_000
    longest: int = 64
    ranges: int = 512


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Token numbers, in order, of all texts, the distinct tokens, and the text of each token. Each text ends with END."""
    words, names, owner = split_words(texts, lower=True)
    distinct = pa.concat_arrays([names, pa.array([END], names.type)])
    n, texts_n = len(words), len(texts)
    place = np.arange(n) + owner  # an end stands after each earlier text
    codes, owners = np.full(n + texts_n, len(distinct) - 1, np.int64), np.zeros(n + texts_n, np.int64)
    codes[place] = words
    ends = np.ones(n + texts_n, bool)
    ends[place] = False
    owners[place], owners[ends] = owner, np.arange(texts_n)
    return codes, distinct, owners


def pair_hashes(hashes: np.ndarray, codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token after the one before it in its text (END before the first), and the code of the one before."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    first = np.ones(len(codes), bool)
    first[1:] = owners[1:] != owners[:-1]
    before[first] = codes[-1] if len(codes) else 0  # the last token of all is an END
    return mixed(hashes[before] * np.uint64(0xD1342543DE82EF95) + hashes[codes]), before


def spot(keys: np.ndarray, level: int, words: np.ndarray | int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a segment of ``words`` 64-bit words, and the bits in it, of each key's entry at a level."""
    x = mixed(keys + np.uint64(level * _BASE % 2**64))
    mask = np.zeros(len(x), np.uint64)
    for k in range(n_bits):
        mask |= np.uint64(1) << (x >> np.uint64(6 * k) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)).astype(np.int64), mask


def probed_levels(words: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Level of each key by probes of level 1, 2, ... in its segment, ``words[begin : begin + size]``; 0 for what isn't held."""
    level, on = np.zeros(len(keys), np.uint8), np.flatnonzero(size > 0)
    for i in range(1, 200):
        at, mask = spot(keys[on], i, size[on], n_bits)
        on = on[words[begin[on] + at] & mask == mask]
        if not len(on):
            break
        level[on] = i
    return level


def counts_of(level: np.ndarray, b: float) -> np.ndarray:
    """The count that stands for a level: the geometric mean of the least and largest one; 0 for level 0."""
    level = level.astype(np.float64)
    low, high = np.ceil(b ** (level - 1.0) - 1e-9), np.ceil(b**level - 1e-9) - 1
    return np.where(level > 0, np.sqrt(low * np.maximum(low, high)), 0.0)


def levels(counts: np.ndarray, b: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(b) + 1e-9).astype(np.int64)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(keys), np.int64)


def short(keys: np.ndarray, segments: int) -> np.ndarray:
    """40 bits of a key below those that choose the segment; counts and probes travel under these."""
    return keys << np.uint64(segments.bit_length() - 1) >> np.uint64(24)


def packed_keys(keys: np.ndarray, size: int = 5) -> np.ndarray:
    """40-bit keys as five bytes each (or so many bits as ``size`` bytes hold)."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def unpacked_keys(blob: bytes, size: int = 5) -> np.ndarray:
    keys = np.zeros((len(blob) // size, 8), np.uint8)
    keys[:, :size] = np.frombuffer(blob, np.uint8).reshape(-1, size)
    return keys.view("<u8").ravel()


@dataclass(frozen=True)
class Ranges:
    """Successive segments that probes travel to together, so that the rows of a block stay few and long at any number of segments."""

    segments: int
    most: int

    @property
    def n(self) -> int:
        return min(self.segments, self.most)

    @property
    def each(self) -> int:
        return self.segments // self.n

    @property
    def size(self) -> int:
        """Bytes of a key: 40 bits, and those that tell the segment within its range."""
        return -(-(40 + self.each.bit_length() - 1) // 8)

    def rows(self, keys: np.ndarray) -> list[tuple[int, bytes]]:
        """Sorted keys by range."""
        bits = 40 + self.each.bit_length() - 1
        small = packed_keys(keys << np.uint64(self.n.bit_length() - 1) >> np.uint64(64 - bits), self.size)
        return [(r, small[part].tobytes()) for r, part in by_segment(keys, self.n)]

    def apart(self, number: int, blob: bytes) -> Iterator[tuple[int, bytes]]:
        """A range's keys by segment, as 40-bit keys."""
        keys = unpacked_keys(blob, self.size)
        segment, small = keys >> np.uint64(40), packed_keys(keys & np.uint64(2**40 - 1))
        for a, b in runs_of(segment):
            yield number * self.each + int(segment[a]), small[a:b].tobytes()


class LogFrequencyFilter:
    """All segments of a filter, for probing by whole keys."""

    def __init__(self, segments: dict[int, bytes], n: int, settings: Settings):
        self.n, self.settings = n, settings
        self.size = np.array([len(segments.get(k, b"")) // 8 for k in range(n)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.frombuffer(b"".join(segments.get(k, b"") for k in range(n)), np.uint64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        s = segment_of(keys, self.n)
        return counts_of(probed_levels(self.words, self.begin[s], self.size[s], short(keys, self.n), self.settings.keys), self.settings.log_base)


def filled(keys: np.ndarray, counts: np.ndarray, settings: Settings) -> bytes:
    """A segment that holds these distinct keys with their counts."""
    level = levels(counts, settings.log_base)
    segment = np.zeros(int(level.sum()) * settings.load // 64 + 1, np.uint64)
    for i in range(1, int(level.max(initial=0)) + 1):
        at, mask = spot(keys[level >= i], i, len(segment), settings.keys)
        np.bitwise_or.at(segment, at, mask)
    return segment.tobytes()


def unigram_key(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def by_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys that lie in one segment."""
    s = segment_of(keys, segments)
    cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
        yield int(s[a]), slice(a, b)


def build_filter(train: DataFrame, vocabulary: DataFrame, total: int, settings: Settings) -> tuple[DataFrame, int]:
    """The staged table (segment, bits), and the number of segments: a power of two that follows from the training tokens."""
    segments = 1 << max(3, (total // settings.share).bit_length())
    blobs = pa.schema([("segment", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def shares(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Sorted keys and their counts, by segment."""
        small, counts = packed_keys(short(keys, segments)), counts.astype("<u4")
        rows = [(s, small[part].tobytes(), counts[part].tobytes()) for s, part in by_segment(keys, segments)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), blobs.types)], schema=blobs)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8 << 20):
            codes, distinct, owners = tokens_of(batch["text"])
            yield shares(*np.unique(pair_hashes(string_hashes(distinct), codes, owners)[0], return_counts=True))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = unigram_key(string_hashes(batch["token"])), np.minimum(batch["n"].to_numpy(), 2**32 - 1)
            order = np.argsort(keys)
            yield shares(keys[order], counts[order])

    def fill(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        keys = unpacked_keys(b"".join(parts["keys"]))
        counts = np.frombuffer(b"".join(parts["counts"]), "<u4").astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pd.DataFrame({"segment": [int(key[0])], "bits": [filled(keys[new], np.add.reduceat(counts, new), settings)]})

    schema = "segment int, keys binary, counts binary"
    every = train.select("text").mapInArrow(pairs, schema).unionByName(vocabulary.select("token", "n").mapInArrow(singles, schema))
    return stage(every.groupBy("segment").applyInPandas(fill, "segment int, bits binary"), "filter"), segments


def count_words(train: DataFrame) -> DataFrame:
    """(token, n) over all training texts, END once for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16 << 20):
            codes, distinct, _ = tokens_of(batch["text"])
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)))], names=["token", "n"])

    return train.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_words(vocabulary: DataFrame, settings: Settings) -> pa.Table:
    """The most frequent words, as many as the bound allows, cut between steps of a logarithmic scale of counts."""
    step = F.floor(F.log2("n") * 8).cast("int")
    able = vocabulary.where(F.octet_length("token") <= settings.longest)
    steps = able.groupBy(step.alias("step")).count().orderBy(F.desc("step")).toPandas()
    fits = steps[steps["count"].cumsum() <= settings.frequent]
    least = int(fits["step"].min()) if len(fits) else 1 << 30
    return able.where(step >= least).select("token", "n").toArrow()


@dataclass(frozen=True)
class Known:
    """What every task knows: exact counts of the frequent words, the denominator of unigram probabilities, and k."""

    table: pa.Table
    scale: float
    prior: float

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is frequent, and its count then."""
        if not self.table.num_rows:
            return np.zeros(len(distinct), bool), np.zeros(len(distinct))
        place = pc.fill_null(pc.index_in(distinct, value_set=self.table["token"].combine_chunks()), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return place >= 0, np.where(place >= 0, self.table["n"].to_numpy()[place], 0).astype(np.float64)


_NAMES = ["row", "id", "token", "n", "known", "base", "score"]
_SCORED = "row long, id long, token string, n long, known long, base double, score double"


def asked(texts: pa.Array, known: Known) -> tuple[tuple, np.ndarray]:
    """The tokens of some texts, and all keys whose counts their scores need: those of pairs and of words that aren't frequent."""
    codes, distinct, owners = tokens_of(texts)
    hashes = string_hashes(distinct)
    exact, count = known.look_up(distinct)
    pair, before = pair_hashes(hashes, codes, owners)
    return (codes, distinct, owners, exact, count, unigram_key(hashes), pair, before), np.unique(np.concatenate([pair, unigram_key(hashes[~exact])]))


def scored(tokens: tuple, rows: np.ndarray, ids: pa.Array, known: Known, counts: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each text and word that isn't frequent."""
    codes, distinct, owners, exact, count, single, pair, before = tokens
    texts = len(rows)
    log_base = np.log10((count + 0.5) / known.scale)
    count[~exact] = counts(single[~exact])
    past, plain = count[before], (count[codes] + 0.5) / known.scale
    chance = (np.minimum(counts(pair), past) + known.prior * plain) / (past + known.prior)
    held = exact[codes]
    yield pa.RecordBatch.from_arrays([
        pa.array(rows), ids, pa.nulls(texts, pa.string()), pa.array(np.bincount(owners, minlength=texts)),
        pa.array(np.bincount(owners, held, texts).astype(np.int64)), pa.array(np.bincount(owners, np.where(held, log_base[codes], 0.0), texts)),
        pa.array(np.bincount(owners, np.log10(chance), texts)),
    ], names=_NAMES)
    cell, n = np.unique(owners[~held] << 32 | codes[~held], return_counts=True)
    yield pa.RecordBatch.from_arrays([
        pa.array(rows[cell >> 32]), pa.nulls(len(cell), pa.int64()), distinct.take(pa.array(cell & 0xFFFFFFFF)), pa.array(n.astype(np.int64)),
        pa.nulls(len(cell), pa.int64()), pa.nulls(len(cell), pa.float64()), pa.nulls(len(cell), pa.float64()),
    ], names=_NAMES)


def _with_broadcast(docs: DataFrame, known: Known, table: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """Scores by a filter that every task holds."""
    context = docs.sparkSession.sparkContext
    held = table.toPandas()
    sent, facts = context.broadcast(LogFrequencyFilter(dict(zip(held["segment"].tolist(), held["bits"])), segments, settings)), context.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, 1 << 20):
            tokens, _ = asked(batch["text"], facts.value)
            yield from scored(tokens, np.arange(row, row + batch.num_rows), batch["id"], facts.value, sent.value.counts)
            row += batch.num_rows

    return docs.mapInArrow(run, _SCORED)


def _by_shuffle(docs: DataFrame, known: Known, table: DataFrame, segments: int, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Scores by a filter that stays a table: the keys that a block of texts asks for go to the segments, and their levels come back,
    in streams sorted by segment and by block, of which a task holds one segment or one block. A block is one row of some
    megabytes; it tells its keys in one order, so that levels come back without them. Keys and levels travel by ranges of segments;
    where a range has several, they are told apart and put together again within the task that has the range."""
    context = docs.sparkSession.sparkContext
    facts, ranges = context.broadcast(known), Ranges(segments, settings.ranges)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, 2 << 20):
            offsets = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([batch[c]])) for c in ("id", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([row]), *lists], names=["block", "ids", "texts"])
            row += batch.num_rows

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = asked(batch["texts"][k].values, facts.value)[1]
                rows = [(r, batch["block"][k].as_py(), blob) for r, blob in ranges.rows(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["range", "block", "keys"])

    def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for number, segment, block, blob, bits in zip(*(batch[c].to_pylist() for c in ("range", "segment", "block", "keys")), batch["bits"]):
                rows = [(segment, None, None, bits.as_py())] if blob is None else [(s, block, part, None) for s, part in ranges.apart(number, blob)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["segment", "block", "keys", "bits"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            done = []
            for block, segment, levels in zip(*(batch[c].to_pylist() for c in ("block", "segment", "levels"))):
                if now != (block, segment // ranges.each):
                    done += [(*now, b"".join(parts))] if parts else []
                    now, parts = (block, segment // ranges.each), []
                parts.append(levels)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else ([], [], []), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "segment", "levels"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, b"".join(parts)), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "segment", "levels"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = -1, np.empty(0, np.uint64)
        for batch in batches:
            segment = batch["segment"].to_numpy()
            bits, blocks_of, blobs = batch["bits"], batch["block"], batch["keys"]
            out_levels, kept = [], []
            for a, b in runs_of(segment):  # a segment's own row comes first, its probes follow, maybe in later batches too
                first = a
                if bits[a].is_valid:
                    now, words, first = segment[a], np.frombuffer(bits[a].as_py(), np.uint64), a + 1
                if first == b:
                    continue
                asked_for = blobs.slice(first, b - first).to_pylist()
                small = unpacked_keys(b"".join(asked_for))
                size = np.full(len(small), len(words) if segment[a] == now else 0)
                level = probed_levels(words, np.zeros(len(small), np.int64), size, small, settings.keys).tobytes()
                ends = np.cumsum([len(k) // 5 for k in asked_for]).tolist()
                out_levels += [level[x:y] for x, y in zip([0, *ends], ends)]
                kept += range(first, b)
            own = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([blocks_of.take(own), batch["segment"].take(own), pa.array(out_levels, pa.binary())], names=["block", "segment", "levels"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for batch in batches:
            is_text, block = batch["texts"].is_valid().to_pylist(), batch["block"].to_numpy()
            levels_of = batch["levels"]
            for k in range(batch.num_rows):
                if not is_text[k]:
                    parts.append(levels_of[k].as_py())
                    continue
                texts = batch["texts"][k].values
                tokens, keys = asked(texts, facts.value)
                level = np.frombuffer(b"".join(parts), np.uint8)  # by segment, and so in the order of the keys
                parts = []
                counts = lambda wanted, keys=keys, level=level: counts_of(level[np.searchsorted(keys, wanted)], settings.log_base)
                yield from scored(tokens, block[k] + np.arange(len(texts)), batch["ids"][k].values, facts.value, counts)

    texts = stage(docs.mapInArrow(blocks, "block long, ids array<long>, texts array<string>"), "blocks")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    sent = texts.mapInArrow(probes, "range int, block long, keys binary")
    own = table.select(F.expr(f"segment div {ranges.each}").cast("int").alias("range"), "segment", none("long", "block"), none("binary", "keys"), "bits")
    probe = F.col("range") if ranges.each == 1 else F.lit(None).cast("int")
    both = own.unionByName(sent.select("range", probe.alias("segment"), "block", "keys", none("binary", "bits"))).repartition("range")
    if ranges.each > 1:
        both = both.mapInArrow(told_apart, "segment int, block long, keys binary, bits binary")
    ordered = both.select("segment", "block", "keys", "bits").sortWithinPartitions("segment", F.col("block").asc_nulls_first())
    found = ordered.mapInArrow(answer, "block long, segment int, levels binary")
    if ranges.each > 1:
        found = found.sortWithinPartitions("block", "segment").mapInArrow(together, "block long, segment int, levels binary")
    answers = stage(found, "answers")
    release(docs.sparkSession)
    back = answers.select("block", none("array<long>", "ids"), none("array<string>", "texts"), "segment", "levels").unionByName(
        texts.select("block", "ids", "texts", none("int", "segment"), none("binary", "levels"))
    )
    return back.repartition("block").sortWithinPartitions("block", F.col("segment").asc_nulls_last()).mapInArrow(finish, _SCORED), [texts, answers]


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """[begin, end) of runs of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist() if len(values) else []
    yield from zip(cuts, [*cuts[1:], len(values)])


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    Both tables need ``text_col``; null texts count as empty. Tokens are the words between ASCII white space, with A-Z lower-cased,
    and one end. base_score is the log10 of smoothed exact unigram frequencies, score the model's log10 probability; without
    training texts every word is unknown. Repeated rows and null ids are scored each for itself; other columns are not read.
    """
    train = train.select(F.col(text_col).alias("text"))
    vocabulary = stage(count_words(train), "vocabulary")
    total, distinct_words = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("token")).first())
    scale = total + 0.5 * (distinct_words + 1)
    known = Known(frequent_words(vocabulary, settings), scale, settings.prior)
    table, segments = build_filter(train, vocabulary, total, settings)
    release(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = 8 * (table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0)
    made, used = (_with_broadcast(own, known, table, segments, settings), []) if bits <= settings.most_bits else _by_shuffle(own, known, table, segments, settings)
    rows = stage(made, "scored")
    discard(table, *used)
    counted = rows.where("token is not null").select("row", "token", "n").join(vocabulary.select("token", F.col("n").alias("c")), "token", "left")
    c = F.coalesce("c", F.lit(0))
    rest = counted.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(scale))).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known")
    )
    return rows.where("token is null").join(rest, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
