"""SimHash near-duplicates by pivot distance tables.

Fingerprints are first made distinct. Each distinct fingerprint gets a table of Hamming distances to reference fingerprints: in
each of five blocks of bits to the parts of seven references that lie there, and over all 64 bits to sixteen more. By the
triangle inequality no coordinate of two fingerprints differs by more than their distance, and none of a block by more than the
bits in which they differ there.

Two fingerprints with at most two differing bits agree on three of the five blocks at least, and so in all coordinates of
these. So cells of the pivot table, one for each choice of three blocks, serve as join keys: every such pair meets. The
coordinates of a block don't tell its bits (about half of the patterns have coordinates of their own), so others meet as well; a
pair is discarded when the largest difference of any coordinate exceeds the radius, and survivors are verified bit by bit.

A cell in which many fingerprints meet isn't paired off. There every member goes to the fingerprints within one bit of it;
two members within two bits of each other meet at one between them, and all that meet at one are within two bits of
each other. So linking each to the smallest one there loses no link and adds none, at a cost in proportion to the members.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import connected_components
from lodestone.plans.staging import discard, stage

RADIUS = 2
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *stops[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    ends = (stops[-n:] - 1).tolist()
    totals = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # a very long text in parts
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins[at : min(n, at + 65536)], ends[at : at + 65536])), np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view(np.int64)[0])


def simhash(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprint (long, bits as in an unsigned 64-bit number) of a text column; null and wordless texts give zero."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, shingle, seed) for t in texts], dtype="int64")

    return fingerprints(text)


def _reference(label: str) -> int:
    """A reference fingerprint, drawn from a hash of its label."""
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little", signed=True)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_coordinates(fp: Column, block: tuple[int, int], references: int = 7) -> list[Column]:
    """Distances of one block of bits to that block of each reference."""
    low, high = block
    mask = F.lit(_signed((1 << high) - (1 << low)))
    return [F.bit_count(fp.bitwiseXOR(F.lit(_reference(f"block pivot {k}"))).bitwiseAND(mask)).cast("byte") for k in range(references)]


def pivot_table(fp: Column, references: int = 7, whole: int = 16) -> tuple[list[list[Column]], list[Column]]:
    """Coordinates by block, and those over all 64 bits."""
    return [block_coordinates(fp, b, references) for b in BLOCKS], [F.bit_count(fp.bitwiseXOR(F.lit(_reference(f"pivot{k}")))).cast("byte") for k in range(whole)]


def meetings(fingerprints: DataFrame, references: int = 7) -> DataFrame:
    """(key, fp): the cells of the pivot table that more than one fingerprint lies in, with their number n."""
    blocks, _ = pivot_table(F.col("fp"), references)
    trios = list(itertools.combinations(range(len(BLOCKS)), 3))
    cells = F.array(*[F.xxhash64(F.lit(t), *[c for i in trio for c in blocks[i]]) for t, trio in enumerate(trios)])
    keyed = fingerprints.select("fp", F.explode(cells).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def met_pairs(met: DataFrame, references: int = 7) -> DataFrame:
    """(src, dst, apart): all pairs that meet in a cell, and the largest difference of a coordinate."""
    blocks, whole = pivot_table(F.col("fp"), references)
    rows = met.withColumn("c", F.array(*[c for b in blocks for c in b], *whole))
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.expr("aggregate(zip_with(a.c, b.c, (x, y) -> abs(x - y)), 0, (m, d) -> greatest(m, d))")
    return a.join(b, [F.col("a.key") == F.col("b.key"), F.col("a.fp") < F.col("b.fp")]).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"), apart.alias("apart"))


def links(fingerprints: DataFrame, radius: int = RADIUS, references: int = 7, most_paired: int = 32) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints, the smaller first, that connect all within ``radius`` (at most 2) bits.

    Cells with up to ``most_paired`` fingerprints give all their verified pairs; larger ones a star at each fingerprint
    between, which connects the same. ``fingerprints`` has one column ``fp``, distinct and not null.
    """
    if not 0 <= radius <= 2:
        raise ValueError("five blocks serve a radius of at most 2 bits")
    met = stage(meetings(fingerprints, references), "pivotmet")
    survivors = met_pairs(met.where(F.col("n") <= most_paired), references).where(F.col("apart") <= radius)
    paired = survivors.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius).select("src", "dst")
    many = met.where(F.col("n") > most_paired).select("fp").distinct()
    if radius == 2:
        between = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)]))
        near = many.select("fp", between.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        centres = near.groupBy("mid").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
        starred = near.join(centres, "mid").where("fp <> src").select("src", F.col("fp").alias("dst"))
    else:
        flips = F.explode(F.array(*[F.lit(_signed(1 << k)) for k in range(64 * radius or 1)]))
        near = many.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        starred = near.join(many.select(F.col("fp").alias("mid")), "mid").where("fp < mid").select(F.col("fp").alias("src"), F.col("mid").alias("dst"))
        if radius == 0:
            starred = starred.limit(0)
    return paired.unionByName(starred).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, list[DataFrame]]:
    """id, tag (the text's CRC-32), fp, component (a fingerprint) and component_id of every row; and the staged tables read."""
    tag = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    prints = stage(docs.select(F.col(id_col).alias("id"), tag.alias("tag"), simhash(F.col(text_col), shingle).alias("fp")), "simhash")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("low")), "fpclass")
    found = connected_components(links(classes.select("fp"), radius))  # node, component
    member = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = member.groupBy("component").agg(F.min("low").alias("component_id"))
    named = member.join(lows, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp"), [prints, classes]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``id_col``, fp (long) and component_id, the smallest id reachable over links.

    Wordless and null texts share the fingerprint zero and are linked like any other. Rows with a null id take part and keep
    their null; a component with null ids alone has a null component_id. Rows that repeat are returned each. Other columns are
    not read.
    """
    return _labelled(docs, id_col, text_col, shingle, radius)[0].select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest id (null first).

    Rows that share an id are told apart by the CRC-32 of their texts; of rows that share both one stays. ``near_copies_dedup`` in
    ``near_copies`` links by a similarity of shingles instead of a number of bits.
    """
    found, staged = _labelled(docs, id_col, text_col, shingle, radius)
    least = found.groupBy("component").agg(F.min(F.struct("id", "tag")).alias("k"))
    first = stage(least.select(F.col("k.id").alias("__near_id"), F.col("k.tag").alias("__near_tag")), "nearest")
    once = staged[0].groupBy("id", "tag").count().where("count > 1").isEmpty()
    discard(*staged)
    tag = F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    stay = docs.join(first, docs[id_col].eqNullSafe(first["__near_id"]) & (tag == first["__near_tag"]), "left_semi")
    return stay if once else stay.dropDuplicates([id_col, text_col])
