"""Phrase collocation mining: double-array tries of Apriori-safe candidates, counted level by level.

Level 1 counts the words of each language. A word of a language is a 64-bit key from then on; the keys of the whole vocabulary are
checked to be distinct, and drawn anew from another hash if they aren't, so counts are exact. A phrase is the bytes of its words' keys.

A phrase can only be frequent if the phrases without its first and without its last word are. At level 2 every pair of frequent
words is a candidate, so the trie would be complete: its accepting states are the pairs themselves, counted sparsely. From level 3 on
the candidates are a join of the level before with itself; each share of them becomes a double-array trie in a task of its own, the
tries are broadcast, and numpy moves the states of all positions of a batch on together, a level at a time. Accepting states are
counted with ``bincount`` and the counts of all shards summed.

Tries hold at most ``most`` phrases together, which is known from sums over the join's keys before a candidate is made: at some 20 bytes
for each that is about 10 MB, what Spark itself broadcasts by default. Where there would be more, as where one word follows and precedes
very many others, the phrases that occur are counted by a shuffle instead, as at level 2; the results are the same. Before that, phrases
are counted by hashed buckets, an array of fixed size for each task: only phrases of buckets that reach the least count go on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.words import mixed, sliced, string_hashes
from lodestone.plans.staging import discard, shuffle_width, stage

LONGEST = 5
BUCKET_BITS = 20
_BREAK = "."  # stands between pieces; no word contains it
_TRIE = {"alphabet": np.uint64, "number": np.int32, "base": np.int32, "check": np.int32}
_COUNTS = pa.schema([("phrase", pa.binary()), ("n", pa.int64())])
_WORD = "unhex(lpad(hex(key), 16, '0'))"  # a word's key as a phrase of one word


# ---- words and keys ----


def word_keys(words: pa.Array, lang: str, seed: int) -> np.ndarray:
    """A 64-bit key of each word in a language; ``seed`` chooses the hash."""
    import xxhash

    if seed == 0:
        hashes = string_hashes(words)
    else:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    return mixed(hashes * np.uint64(0xD1342543DE82EF95) + np.uint64(xxhash.xxh64_intdigest(lang, seed)))


def by_language(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language in a batch; null texts are empty, a null language is "und"."""
    for batch in sliced(batches, most):
        langs, texts = pc.fill_null(batch["lang"], "und"), pc.fill_null(batch["text"], "")
        for lang in pc.unique(langs).to_pylist():
            yield lang, texts.filter(pc.equal(langs, lang))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, int]:
    """Word numbers of all texts in order, the distinct words, and the number that stands between pieces and texts."""
    parted = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\n-\r]", f" {_BREAK} ")
    words = pc.list_flatten(pc.ascii_split_whitespace(pc.binary_join_element_wise(parted, _BREAK, " ")))
    coded = pc.dictionary_encode(words.filter(pc.not_equal(words, "")))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    at = pc.index(coded.dictionary, _BREAK).as_py()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, at


def count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for lang, texts in by_language(batches):
        codes, words, stop = words_of(texts)
        counts = np.bincount(codes, minlength=len(words))
        counts[stop] = 0
        real = np.flatnonzero(counts)
        names = words.take(pa.array(real))
        keys = word_keys(names, lang, seed).astype(np.int64) if len(real) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(real), pa.string()), names.cast(pa.string()), pa.array(keys), pa.array(counts[real])], names=["lang", "word", "key", "n"])


# ---- streams: numbers of words, and their keys by number; number 0 is a break with key 0 ----


def text_streams(batches: Iterator[pa.RecordBatch], seed: int, frequent: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of whole texts; those not among the ``frequent`` keys (sorted) become breaks."""
    for lang, texts in by_language(batches):
        codes, words, stop = words_of(texts)
        keys = word_keys(words, lang, seed)
        known = np.ones(len(keys), bool) if frequent is None else held(frequent, keys)
        known[stop] = False
        number = np.zeros(len(keys), np.int64)
        number[known] = np.arange(1, known.sum() + 1)
        yield number[codes], np.concatenate([np.zeros(1, np.uint64), keys[known]])


def kept_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of a staged table of runs."""
    for batch in batches:
        tokens = pc.list_flatten(batch["tokens"]).to_numpy().view(np.uint64)
        keys, codes = np.unique(np.concatenate([np.zeros(1, np.uint64), tokens]), return_inverse=True)
        yield codes[1:], keys


def held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def phrase_bytes(keys: np.ndarray) -> pa.Array:
    """Rows of word keys as binary values."""
    rows, k = keys.shape
    data = np.ascontiguousarray(keys, ">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, rows * k * 8 + 1, k * 8, np.int32)), pa.py_buffer(data)])


def counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([phrase_bytes(keys), pa.array(counts.astype(np.int64))], schema=_COUNTS)


def bucketed(codes: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of phrases of k words without a break, and the bucket of each."""
    at = np.arange(max(0, len(codes) - k + 1))
    for j in range(k):
        at = at[codes[at + j] > 0]
    x = np.zeros(len(at), np.uint64)
    for j in range(k):
        x = x * np.uint64(0xD1342543DE82EF95) + keys[codes[at + j]]
    return at, (mixed(x) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def live_buckets(rows: DataFrame, streams, k: int, least: int) -> np.ndarray:
    """Which buckets the phrases of k words fill at least ``least`` times; no phrase of another bucket is so frequent."""
    size = 1 << 16
    schema = "chunk int, share int, n binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for codes, keys in streams(batches):
            total += np.bincount(bucketed(codes, keys, k)[1], minlength=len(total))
        if total.any():
            chunks = len(total) // size
            yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * chunks, pa.int32()), pa.array([np.minimum(total[i * size : (i + 1) * size], least).astype(np.uint32).tobytes() for i in range(chunks)], pa.binary())], names=["chunk", "share", "n"])

    def added(part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for n in part["n"]:
            total += np.frombuffer(n.as_buffer(), np.uint32)
        return pa.table({"chunk": part["chunk"][:1], "share": part["share"][:1], "n": [np.minimum(total, least).astype(np.uint32).tobytes()]})

    # Sums of up to ``least`` are enough, and in two steps no task adds up the arrays of all others.
    sums = rows.mapInArrow(count, schema).groupBy("chunk", "share").applyInArrow(added, schema).groupBy("chunk").applyInArrow(added, schema)
    live = np.zeros(1 << BUCKET_BITS, bool)
    for r in sums.collect():
        live[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["n"], np.uint32) >= least
    return live


def phrases_in(codes: np.ndarray, keys: np.ndarray, k: int, live: np.ndarray | None = None) -> pa.RecordBatch:
    """Every phrase of k words without a break (of a live bucket, if these are given), with its count."""
    at, bucket = bucketed(codes, keys, k)
    if live is not None:
        at = at[live[bucket]]
    number, first, counts = codes[at], np.arange(len(at)), np.ones(len(at), np.int64)
    for j in range(1, k):
        _, first, number, counts = np.unique(number * len(keys) + codes[at + j], return_index=True, return_inverse=True, return_counts=True)
    begin = at[first]
    return counted(keys[codes[begin[:, None] + np.arange(k)]], counts)


# ---- double-array tries ----


def build_trie(phrases: np.ndarray) -> dict[str, np.ndarray]:
    """A trie over distinct phrases (rows of k word keys): alphabet (sorted keys) and their numbers, base and check.

    State 0 is the root; from state s the word with number c leads to base[s] + c if check of that place is s. Frequent words have
    small numbers, and nodes with many words are placed first, so that the others fit between.
    """
    alphabet, codes, counts = np.unique(phrases, return_inverse=True, return_counts=True)
    number = np.empty(len(alphabet), np.int32)
    number[np.argsort(-counts, kind="stable")] = np.arange(len(alphabet))
    codes = number[codes.reshape(phrases.shape)]
    codes = codes[np.lexsort(codes.T[::-1])]
    size = len(alphabet) + codes.size + 16
    base, check, used, last = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool), 1
    used[0] = True
    free, state = 1, np.zeros(len(codes), np.int64)
    for level in range(codes.shape[1]):
        new = np.ones(len(codes), bool)
        new[1:] = (state[1:] != state[:-1]) | (codes[1:, level] != codes[:-1, level])
        edges = np.flatnonzero(new)
        parent, child = state[edges], codes[edges, level].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        ends = np.append(cuts[1:], len(edges))
        target = np.zeros(len(edges), np.int64)
        for i in np.argsort(cuts - ends, kind="stable").tolist():  # nodes with most words first
            a, b = int(cuts[i]), int(ends[i])
            span = child[a:b] - child[a]
            wide, place, tries = int(span[-1]), free, 0
            while True:
                if place + wide >= size:
                    more = size + wide
                    base, check, used, size = np.concatenate([base, np.zeros(more, np.int32)]), np.concatenate([check, np.full(more, -1, np.int32)]), np.concatenate([used, np.zeros(more, bool)]), size + more
                if not used[place] and not used[place + span].any():
                    break
                place, tries = (place + 1, tries + 1) if tries < 64 else (max(place, last - wide) + 1, tries)
            base[parent[a]] = place - child[a]
            target[a:b] = place + span
            used[target[a:b]] = True
            check[target[a:b]] = parent[a]
            last = max(last, place + wide)
            while free < size - 1 and used[free]:
                free += 1
        state = target[np.cumsum(new) - 1]
    return {"alphabet": alphabet, "number": number, "base": base[: last + 1], "check": check[: last + 1]}


def advance(trie: dict[str, np.ndarray], codes: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next k words the trie accepts, and their states: all positions' states move on together."""
    alphabet, base, check = trie["alphabet"], trie["base"], trie["check"]
    number = np.full(len(keys), -1, np.int64)
    known = held(alphabet, keys)
    known[0] = False
    number[known] = trie["number"][np.searchsorted(alphabet, keys[known])]
    words = number[codes]
    at = np.arange(max(0, len(codes) - k + 1))
    state = np.zeros(len(at), np.int64)
    for j in range(k):
        word = words[at + j]
        goal = base[state] + word
        there = (word >= 0) & (goal >= 0) & (goal < len(check))
        there[there] = check[goal[there]] == state[there]
        at, state = at[there], goal[there]
    return at, state


def spelled(trie: dict[str, np.ndarray], states: np.ndarray, k: int) -> np.ndarray:
    """Word keys on the way from the root to each state."""
    out, word = np.zeros((len(states), k), np.uint64), np.argsort(trie["number"])
    for j in reversed(range(k)):
        parent = trie["check"][states]
        out[:, j] = trie["alphabet"][word[states - trie["base"][parent]]]
        states = parent
    return out


def tries_of(phrases: DataFrame, n: int, k: int, share: int) -> list[dict[str, np.ndarray]]:
    """Tries over ``n`` phrases of k words, each built in a task from about ``share`` of them; those that begin alike share one."""

    def build(rows: pa.Table) -> pa.Table:
        data = b"".join(rows["phrase"].to_pylist())
        trie = build_trie(np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, k))
        return pa.table({name: [trie[name].tobytes()] for name in _TRIE})

    shares = phrases.withColumn("share", F.pmod(F.xxhash64(F.expr("substring(phrase, 1, 8)")), F.lit(max(1, -(-n // share)))))
    built = shares.groupBy("share").applyInArrow(build, ", ".join(f"{name} binary" for name in _TRIE)).toLocalIterator()
    return [{name: np.frombuffer(t[name], kind) for name, kind in _TRIE.items()} for t in built]


def runs_of(codes: np.ndarray, keys: np.ndarray, tries: list[dict[str, np.ndarray]], row: int = 512) -> pa.RecordBatch:
    """What of a stream is worth reading again: words of any three in a row whose pairs are both frequent, breaks between."""
    good = np.zeros(len(codes) + 2, bool)
    for trie in tries:
        good[advance(trie, codes, keys, 2)[0]] = True
    three = good[:-1] & good[1:]
    kept = three[:-1].copy()  # by position of the stream and one beyond it
    kept[1:] |= three[:-2]
    kept[2:] |= three[:-3]
    at = np.flatnonzero(kept[: len(codes)])
    broken = np.ones(len(at), bool)
    broken[1:] = (at[1:] - at[:-1] > 1) | ~good[at[1:] - 1]
    tokens = np.zeros(len(at) + int(broken.sum()), np.uint64)
    tokens[np.arange(len(at)) + np.cumsum(broken)] = keys[codes[at]]
    breaks = np.flatnonzero(tokens == 0)
    cuts = np.unique(breaks[np.searchsorted(breaks, np.arange(0, len(tokens), row)).clip(max=len(breaks) - 1)]) if len(breaks) else np.empty(0, np.int64)
    offsets = np.append(cuts, len(tokens)) if len(cuts) else np.zeros(1, np.int64)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.view(np.int64)))], names=["tokens"])


# ---- levels ----


def vocabulary_of(docs: DataFrame, seeds: range = range(8)) -> tuple[DataFrame, int]:
    """The staged table (lang, word, key, n) and the first seed under which its keys are distinct."""
    for seed in seeds:
        words = docs.mapInArrow(lambda batches, s=seed: count_words(batches, s), "lang string, word string, key long, n long")
        found = stage(words.groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "vocabulary")
        if found.groupBy("key").count().where("count > 1 or key = 0").isEmpty():
            return found, seed
        discard(found)
    raise ValueError("no seed gives every word a key of its own")


def frequent_phrases(docs: DataFrame, vocabulary: DataFrame, seed: int, least: int, longest: int, most: int, share: int) -> list[DataFrame]:
    """Staged tables (phrase, a) of the phrases of 1, 2, ... words that occur at least ``least`` times."""
    spark = docs.sparkSession
    words = vocabulary.where(F.col("n") >= least)
    one = stage(words.select(F.expr(_WORD).alias("phrase"), F.col("n").alias("a")), "phrases1")
    levels = [one]
    n_words = one.count()
    known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in words.select("key").toLocalIterator()], np.int64).view(np.uint64)) if n_words <= most else None)

    def summed(counts: DataFrame, k: int) -> DataFrame:
        return stage(counts.groupBy("phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"phrases{k}")

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return text_streams(batches, seed, known.value)

    runs = None
    for k in range(2, longest + 1):
        last = levels[-1]
        streams, read = (from_texts, docs) if runs is None else (kept_streams, runs)
        tail, head = F.expr(f"substring(phrase, 9, {8 * (k - 2)})"), F.expr(f"substring(phrase, 1, {8 * (k - 2)})")
        wanted = None
        if k > 2:
            before, after = last.groupBy(tail.alias("middle")).agg(F.count(F.lit(1)).alias("x")), last.groupBy(head.alias("middle")).agg(F.count(F.lit(1)).alias("y"))
            wanted = before.join(after, "middle").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0))).first()[0]
        if wanted is not None and wanted <= most:
            left, right = last.select(tail.alias("middle"), F.col("phrase").alias("first")), last.select(head.alias("middle"), F.expr(f"substring(phrase, {8 * (k - 2) + 1}, 8)").alias("next"))
            candidates = left.join(right, "middle").select(F.concat("first", "next").alias("phrase"))
            tries = spark.sparkContext.broadcast(tries_of(candidates, int(wanted), k, share) if wanted else [])

            def count(batches: Iterator[pa.RecordBatch], k: int = k, tries=tries, streams=streams) -> Iterator[pa.RecordBatch]:
                totals: list = [0] * len(tries.value)
                for codes, keys in streams(batches):
                    for i, trie in enumerate(tries.value):
                        totals[i] = totals[i] + np.bincount(advance(trie, codes, keys, k)[1], minlength=len(trie["check"]))
                for trie, total in zip(tries.value, totals):
                    states = np.flatnonzero(total)
                    yield counted(spelled(trie, states, k), total[states]) if len(states) else counted(np.zeros((0, k), np.uint64), np.zeros(0))
        else:
            live = spark.sparkContext.broadcast(live_buckets(read, streams, k, least) if runs is not None else None)

            def count(batches: Iterator[pa.RecordBatch], k: int = k, streams=streams, live=live) -> Iterator[pa.RecordBatch]:
                for codes, keys in streams(batches):
                    yield phrases_in(codes, keys, k, live.value)

        levels.append(summed(read.mapInArrow(count, "phrase binary, n long"), k))
        if k == 2 and k < longest and (n_pairs := levels[-1].count()) <= most:
            pairs = spark.sparkContext.broadcast(tries_of(levels[-1], n_pairs, 2, share) if n_pairs else [])

            def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for codes, keys in from_texts(batches):
                    yield runs_of(codes, keys, pairs.value)

            runs = stage(docs.mapInArrow(keep, "tokens array<long>"), "runs")
    if runs is not None:
        discard(runs)
    return levels


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST, percent: int = 100, top: int = 2000, most: int = 1 << 19, share: int = 1 << 16) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased, texts split at ``. , ; : ! ?`` and line ends into pieces, pieces at spaces and tabs into words; n counts a
    language's words, a phrase's occurrences (overlaps included) within pieces. Phrases of 2 to ``longest`` words that occur ``least`` times
    score floor(1000 a n / (l r)) at their lowest-scoring cut into parts that occur l and r times. One that lies within a longer phrase
    with at least ``percent`` per cent of its occurrences is dropped. Null texts are empty, a null language is "und"; repeated rows count
    each; without any frequent phrase, or for an empty table, the result is empty. Ties go by a, then by the phrase's bytes. Other
    columns are not read. Texts are read whole; one long text is held by one task at a time.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    vocabulary, seed = vocabulary_of(texts)
    levels = frequent_phrases(texts, vocabulary, seed, least, longest, most, share)
    candidates = functools.reduce(DataFrame.unionByName, levels[1:])
    known = candidates.unionByName(levels[0]).select(F.col("phrase").alias("part"), F.col("a").alias("f"))
    words = vocabulary.where(F.col("n") >= least).select(F.expr(_WORD).alias("part"), "word", "lang")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    size = F.expr("octet_length(phrase) div 8").cast("int")

    placed = candidates.withColumn("part", F.expr("substring(phrase, 1, 8)")).join(words.drop("word"), "part").drop("part").join(totals, "lang")
    cuts = placed.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    left = cuts.withColumn("part", F.expr("substring(phrase, 1, 8 * k)")).join(known, "part").withColumnRenamed("f", "l")
    both = left.withColumn("part", F.expr("substring(phrase, 8 * k + 1)")).join(known, "part").withColumnRenamed("f", "r")
    whole = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two have 38 digits
    worth = both.withColumn("x", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)")).cast("decimal(19,0)") * whole("n")).withColumn("y", whole("l") * whole("r")).withColumn("score", F.expr("x div y"))
    lowest = worth.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))

    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> substring(phrase, 8 * i - 7, 8 * m))))")
    within = candidates.withColumn("size", size).where("size > 2").select(F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    stay = lowest.join(within, "phrase", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
    spelt = stay.select("phrase", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.expr("phrase").substr(i * 8 + 1, F.lit(8)))).alias("place", "part")).join(words.drop("lang"), "part")
    text = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = stay.join(text, "phrase").select("lang", F.col("text").alias("phrase"), "a", "at.l", "at.r", "n", "at.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession))))  # a language's phrases are first cut down in shares
    short = salted.withColumn("rank", best("lang", "salt")).where(F.col("rank") <= top)
    return short.withColumn("rank", best("lang").cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
