"""SimHash near-dedup at a given similarity of word shingles: fingerprints link what they can, an exact search finds the rest.

Every text has its set of distinct shingles of five words (one of all words where there are fewer). Near copies are sets with a
Jaccard similarity of at least 0.8. Two such sets may differ in some ten of 64 fingerprint bits, a radius at which pivot
distances discard next to nothing, so fingerprints alone can't find them all. Three searches propose pairs:

1. Fingerprints within two bits, by ``simhash.links`` and its pivot distance tables.
2. Stars. All sets are sorted in one global order; two sets of similarity 0.8 share a shingle among the first
   n - ceil(0.8 n) + 1 of each, n being the set's size, so an equality join on those misses no pair. This holds in any order: here
   shingles that are frequent in a sample of the texts come last, and so seldom serve as keys. Under each key all sets are
   compared with a few centres, which joins large groups of copies at a cost in proportion to their size.
3. Pairs. What meets under a key and still lies in unequal components is compared in pairs, so that nothing is missed.

Parity sketches, folded ones before whole ones, rule pairs out without a loss, and whole sets verify the others. The first two
searches save work and decide nothing: the components are those of all similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.simhash import links
from lodestone.llm.words import mixed, sliced, split_words, string_hashes
from lodestone.operators.graph import connected_components
from lodestone.plans.staging import discard, release, stage

SHINGLE = 5
SIMILARITY = (4, 5)  # at least four fifths
CENTRES = 4
MANY = 64
BROADCAST = 500_000
FOLD = 4
_RUN = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_SMALL = ("s0", "s1", "s2", "s3")
_HELD = "id long, tag long, digest long, n int, fp long, odd binary, s0 long, s1 long, s2 long, s3 long, keys array<long>"


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, A-Z lower-cased; empty without words."""
    codes, distinct, owner = split_words(texts, lower=True)
    words = string_hashes(distinct)[codes]
    sizes = np.bincount(owner, minlength=len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    whole = max(0, len(words) - shingle + 1)
    grams = np.zeros(whole, np.uint64)
    for k in range(shingle):
        grams = grams * np.uint64(_STEP) + words[k : k + whole]
    grams = mixed(grams)
    out = []
    for b, n in zip(begins.tolist(), sizes.tolist()):
        if n >= shingle:
            out.append(np.unique(grams[b : b + n - shingle + 1]))
        else:
            code = np.full(1, n, np.uint64)
            for h in words[b : b + n]:
                code = code * np.uint64(_STEP) + h
            out.append(mixed(code) if n else np.empty(0, np.uint64))
    return out


def similar(a: Column, b: Column) -> Column:
    """Whether two sets (arrays) have at least the wanted similarity, in whole numbers."""
    p, q = SIMILARITY
    return F.size(F.array_intersect(a, b)) * (p + q) >= p * (F.size(a) + F.size(b))


def digest_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64)) if len(shingles) else 0


def odd_sketch(shingles: np.ndarray, bits: int | None = None) -> bytes:
    """A bit for each bucket: whether an odd number of the shingles lies in it. Two sketches of one size differ in no more bits than
    their sets in shingles. Without ``bits`` there are four buckets or more for each shingle."""
    bits = bits or 1 << max(11, (4 * len(shingles)).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as one of ``size`` bytes; it has the parities that a sketch made with fewer bits has."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the larger one is folded to the smaller one's size."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def fingerprint(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set, signed; zero for the empty set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 16):
        total += np.unpackbits(shingles[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view(np.int64)[0])


def frequent_shingles(docs: DataFrame, text: Column, every: int = 64, least: int = 4, most: int = 200_000) -> np.ndarray:
    """At most ``most`` shingles, sorted, that ``least`` texts of one in ``every`` have; they only decide an order."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            grams = np.concatenate([*shingle_sets(batch["text"]), np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = some.mapInArrow(sets, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = counted.orderBy(F.desc("n"), "gram").limit(most).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag (the text's CRC-32), digest of the set, its size n, fingerprint, parity sketch, and first shingles."""
    text = F.col(text_col)
    last = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text))
    p, q = SIMILARITY

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = last.value
        for batch in sliced(batches, _RUN):
            sets, keys = shingle_sets(batch["text"]), []
            for grams in sets:
                n = len(grams)
                take = n - (p * n + q - 1) // q + 1 if n else 0
                if len(heavy) and n:
                    at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
                    late = heavy[at] == grams
                    grams = np.concatenate([grams[~late], grams[late]])
                keys.append(grams[:take].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            own = [pa.array([f(g) for g in sets], kind) for f, kind in ((digest_of, pa.int64()), (len, pa.int32()), (fingerprint, pa.int64()), (odd_sketch, pa.binary()))]
            small = np.frombuffer(b"".join([odd_sketch(g, 256) for g in sets]), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["tag"], *own, *(pa.array(small[:, k]) for k in range(4)), lists], names=["id", "tag", "digest", "n", "fp", "odd", *_SMALL, "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _tag(docs, text_col).alias("tag"), text.alias("text"))
    return stage(rows.mapInArrow(measure, _HELD), "measured")


def _tag(docs: DataFrame, text_col: str) -> Column:
    return F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary"))


def near(a: Column | str, b: Column | str) -> Column:
    """Whether two set sizes allow the wanted similarity."""
    p, q = SIMILARITY
    return F.least(a, b) * q >= F.greatest(a, b) * p


def _plausible(a: str, b: str) -> Column:
    """Whether two sets (prefixes of column names) may be similar by their sizes and small parity sketches."""
    p, q = SIMILARITY
    differ = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in _SMALL[1:]), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    return near(f"{a}n", f"{b}n") & (differ * (p + q) <= (q - p) * (F.col(f"{a}n") + F.col(f"{b}n")))


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (src, dst) of digests whose sketches differ in no more bits than similar sets can in shingles, a ninth of both
    sizes. A pair carries sketches folded to a quarter first, a bit or two for each shingle; whole ones go only to the pairs that these leave."""
    p, q = SIMILARITY

    @F.pandas_udf("binary")
    def fold(odd: pd.Series) -> pd.Series:
        return odd.map(lambda s: folded(s, len(s) // FOLD).tobytes())

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([differing(x, y) * (p + q) <= (q - p) * k for x, y, k in zip(a, b, n)], dtype="bool")

    def left(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        once = sketches.dropDuplicates(["digest"])
        a, b = (once.select(F.col("digest").alias(k), F.col("odd").alias(f"odd_{k}"), F.col("n").alias(f"n_{k}")) for k in ("src", "dst"))
        both = pairs.join(a, "src").join(b, "dst").where(near("n_src", "n_dst"))
        return both.where(may("odd_src", "odd_dst", (F.col("n_src") + F.col("n_dst")).cast("long"))).select("src", "dst")

    rough = stage(left(pairs, sketches.select("digest", "n", fold("odd").alias("odd"))), "rough")
    release(pairs.sparkSession)
    out = stage(left(rough, sketches), "likely")
    discard(rough)
    return out


def _verified(likely: DataFrame, docs: DataFrame, measured: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose sets are similar. Sets are made again from one text for each digest that occurs in a pair."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            found = shingle_sets(batch["text"])
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(g) for g in found], pa.int64()), lists], names=["digest", "grams"])

    ends = likely.select(F.col("src").alias("digest")).unionByName(likely.select(F.col("dst").alias("digest"))).distinct()
    of = measured.select("digest", "id", "tag").join(ends, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("id", "tag")).alias("of"))
    wanted = stage(of.select(F.col("of.id").alias("__id"), F.col("of.tag").alias("__tag")), "wanted")
    texts = _matching(docs, wanted, id_col, text_col, "left_semi").select(F.col(text_col).alias("text"))
    # Rows that share id and tag with a wanted one may have another text; a digest that repeats only repeats its links.
    sets = stage(texts.mapInArrow(grams, "digest long, grams array<long>"), "sets")
    a, b = (sets.select(F.col("digest").alias(k), F.col("grams").alias(f"of_{k}")) for k in ("src", "dst"))
    out = stage(likely.join(a, "src").join(b, "dst").where(similar(F.col("of_src"), F.col("of_dst"))).select("src", "dst").distinct(), "similar")
    discard(sets, wanted)
    return out


def _matching(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Rows of ``docs`` with (or, ``left_anti``, without) their id and tag among the staged ``keys`` (__id, __tag). Up to BROADCAST keys, of
    some twenty bytes each, are sent to every task, so that texts stay where they are; more are joined."""
    few = F.broadcast(keys) if keys.count() <= BROADCAST else keys
    return docs.join(few, docs[id_col].cast("long").eqNullSafe(keys["__id"]) & (_tag(docs, text_col) == keys["__tag"]), how)


def _stars(named: DataFrame, turn: int) -> DataFrame:
    """(src, dst) of each set and a few centres of every key that joins unequal components, where they may be similar."""
    centre = lambda k: F.min(F.struct(F.xxhash64("digest", F.lit(turn * CENTRES + k)).alias("order"), "digest", "component", "n", *_SMALL))
    centres = named.groupBy("key").agg(F.array(*[centre(k) for k in range(CENTRES)]).alias("cs"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    each = named.join(centres.where("lo <> hi").select("key", "cs"), "key").withColumn("c", F.explode("cs"))
    apart = each.where((F.col("component") != F.col("c.component")) & _plausible("", "c."))
    return apart.select(F.least("digest", F.col("c.digest")).alias("src"), F.greatest("digest", F.col("c.digest")).alias("dst")).distinct()


def _by_fingerprint(measured: DataFrame) -> DataFrame:
    """(src, dst) of sets whose fingerprints are equal or linked by the pivot tables."""
    classes = measured.groupBy("fp").agg(F.min("digest").alias("low"))
    same = measured.select("fp", "digest").join(classes, "fp").where("digest <> low").select(F.col("low").alias("src"), F.col("digest").alias("dst"))
    a, b = (classes.select(F.col("fp").alias(k), F.col("low").alias(f"of_{k}")) for k in ("src", "dst"))
    linked = links(classes.select("fp")).join(a, "src").join(b, "dst").select(F.col("of_src").alias("src"), F.col("of_dst").alias("dst"))
    both = same.unionByName(linked)
    return both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def similar_sets(docs: DataFrame, measured: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """(node, component) of the digests that are linked to others; links are similarities of at least 0.8, all found.

    While the sets that meet in unequal components meet over ``many`` others on average, and stars settle them, stars are drawn
    around new centres; then all pairs that meet in unequal components are compared.
    """
    keyed = measured.select("digest", F.explode("keys").alias("key"))
    shared = stage(keyed.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("key"), "prefixshared")
    release(docs.sparkSession)
    keys = keyed.join(shared, "key").select("digest", "key").distinct()
    met = stage(keys.join(measured.select("digest", "n", *_SMALL).dropDuplicates(["digest"]), "digest"), "prefixmet")
    discard(shared)
    sketches = measured.select("digest", "odd", "n")
    proposed, turn, linked, before = _by_fingerprint(measured), 0, None, None
    named = met.withColumn("component", F.col("digest"))
    while True:
        likely = _likely(proposed.unionByName(_stars(named, turn)).distinct(), sketches)
        more = _verified(likely, docs, measured, id_col, text_col)
        linked = more if linked is None else stage(linked.unionByName(more).distinct(), "linked")
        found = stage(connected_components(linked).withColumnRenamed("node", "digest"), "starcomponents")
        named = met.join(found, "digest", "left").select("key", "digest", "n", *_SMALL, F.coalesce("component", "digest").alias("component"))
        unlike = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
        left = stage(named.join(unlike, "key"), "opened")
        discard(likely)
        # What pairs would cost, in comparisons: another round pays while that is many times a round's, and the last one settled a tenth.
        cost, rows = left.agg(F.sum("m"), F.count(F.lit(1))).first()
        if (cost or 0) <= many * rows or before is not None and cost > 0.9 * before:
            break
        named, proposed, turn, before = left.drop("m"), proposed.limit(0), turn + 1, cost
    a, b = left.alias("a"), left.alias("b")
    apart = [F.col("a.key") == F.col("b.key"), F.col("a.digest") < F.col("b.digest"), F.col("a.component") != F.col("b.component"), _plausible("a.", "b.")]
    pairs = a.join(b, apart).select(F.col("a.digest").alias("src"), F.col("b.digest").alias("dst")).distinct()
    likely = _likely(pairs, sketches)
    paired = _verified(likely, docs, measured, id_col, text_col)
    out = connected_components(linked.unionByName(paired))
    discard(met, left, likely)
    return out


def near_copies_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component of near copies the one with the smallest id
    (null first). Wordless and null texts are copies of each other. Rows that share an id are told apart by the CRC-32 of their
    texts; of rows that share both one stays. An empty table gives an empty result."""
    measured = _measured(docs, id_col, text_col)
    found = similar_sets(docs, measured, id_col, text_col)
    named = measured.join(found, measured["digest"] == found["node"], "left").select("id", "tag", F.coalesce("component", "digest").alias("component"))
    named = stage(named, "named")
    least = named.groupBy("component").agg(F.min(F.struct("id", "tag")).alias("k"))
    key = F.struct("id", "tag")
    gone = named.join(least, "component").where(~key.eqNullSafe(F.col("k"))).select(F.col("id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    lost = stage(gone, "lost")
    once = measured.groupBy("id", "tag").count().where("count > 1").isEmpty()
    discard(measured, named)
    stay = _matching(docs, lost, id_col, text_col, "left_anti")
    return stay if once else stay.dropDuplicates([id_col, text_col])
