"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the nine 5-word grams in every 13-word window the one with the least hash, so any passage of
13 words that two documents share holds an anchor that both pick at the same place. Documents are joined on anchors. Around
anchors that occur in two documents every window that picked them asks for its partner, the earliest place where a window with
its hash begins: that of the smallest id, and there the first. Partners of successive windows that follow each other in the same document are
one match; it is extended to both sides as far as it goes, which makes it maximal on its diagonal.

Hashes only propose. Every match is verified: the words of the partner's passage are brought to the document and compared
with its own, word by word. Windows of a match that differs (a collision of hashes) are grouped again by their words themselves.

Counting is done by partial aggregates and joins back, so a passage found in a third of all documents is a skewed join side,
which Spark splits, and no group is gathered. A partner's passage is cut out once for each distinct match in it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import give_back, sequence_hashes, sliced, split_words, string_hashes
from lodestone.plans.staging import discard, release, stage

WINDOW = 13
GRAM = 5
FIRST = -(2**63)
START_BITS = 25
PARTS = 2
_RUN = 1 << 20
_ROWS = 512
_SPANS = "array<struct<begin: int, end: int>>"


def picks(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window the place of the gram with the least hash in it, the last of equals."""
    reach = window - gram + 1
    size = max(0, len(grams) - reach + 1)
    best, at = grams[:size].copy(), np.arange(size)
    for k in range(1, reach):
        other = grams[k : k + size]
        better = other <= best
        best[better] = other[better]
        at[better] = np.flatnonzero(better) + k
    return at


def _windows(texts: pa.Array, window: int, gram: int, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """Hashes of words and of grams; for each window its text, the text's first word, its own first word, its pick."""
    codes, distinct, owner = split_words(texts)
    words = string_hashes(distinct)[codes] & mask
    n = max(0, len(words) - window + 1)
    whole = np.flatnonzero(owner[:n] == owner[len(words) - n :])
    grams = sequence_hashes(words, gram) & mask
    text_begin = np.searchsorted(owner, np.arange(len(texts)))
    return words, grams, owner[whole], text_begin[owner[whole]], whole, picks(grams, window, gram)[whole]


def words_of(text: str | None) -> list[bytes]:
    return ("" if text is None else text).encode("utf-8", "surrogatepass").split()


def runs(doc: np.ndarray, starts: np.ndarray, low: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Matches (doc, begin, end, low, partner of begin): windows of a document at successive starts whose partners follow each
    other in one document."""
    order = np.lexsort((starts, doc))
    doc, starts, low, at = doc[order], starts[order], low[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(low) != 0) | (np.diff(starts) != 1) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], starts[first], starts[last] + window, low[first], at[first]


def lists_of(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, list]:
    """Of a list column of structs the row of each element, and the fields' elements."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    inner = column.flatten()
    return row, [inner.field(f) for f in fields]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdict(words: list[bytes], begin: np.ndarray | None, end: np.ndarray | None, passage: np.ndarray | None) -> tuple[list, list]:
    """Spans of a document's words that equal their partners' passages, joined; and the places of those that don't."""
    if begin is None:
        return [], []
    places = list(zip(begin.tolist(), end.tolist()))
    # Two rows may share the partner's id: one passage that is equal suffices.
    same = {(a, b) for (a, b), p in zip(places, passage) if b" ".join(words[a:b]) == p}
    return merged(list(same)), sorted(set(places) - same)


def listed(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"begin": a, "end": b} for a, b in spans]


def text_tag(text: Column) -> Column:
    """A text's CRC-32 as an int; it tells apart most rows that share an id."""
    return (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) - F.lit(2147483648)).cast("int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hash_bits: int = 64) -> DataFrame:
    """(id, tag, spans): for each document with repeats its maximal repeats, as [begin, end) words.

    A word lies in a repeat if a window covers it whose words also start in a document with a smaller id. A null id counts as
    smaller than all others and comes out as the least long; of rows that share an id and have repeats each has its own tag.
    ``hash_bits`` below 64 makes collisions frequent, and changes no result.
    """
    texts, matches, mask = _matches(docs, id_col, text_col, window, gram, hash_bits)
    each, passages = _brought(texts, matches)

    @F.pandas_udf(f"spans {_SPANS}, doubts {_SPANS}")
    def compare(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            told = [verdict(words_of(text), *found) for text, *found in zip(*columns)]
            yield pd.DataFrame([(listed(spans), listed(doubts)) for spans, doubts in told], columns=["spans", "doubts"])
            give_back()

    met = texts.join(each, ["id", "tag"]).select("id", "tag", compare("text", "found.begin", "found.end", "found.passage").alias("told"))
    checked = stage(met.select("id", "tag", "told.*"), "checked")
    discard(matches, passages)
    if not checked.where("size(doubts) > 0").isEmpty():
        checked = _settled(texts, checked, window, gram, mask)
    return checked.where("size(spans) > 0").select("id", "tag", "spans")


def _matches(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hash_bits: int) -> tuple[DataFrame, DataFrame, np.uint64]:
    """The texts (id, tag, text), and the staged matches (id, tag, begin, end, low, at) that their hashes propose."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("id"), F.col(text_col).alias("text"))
    mask = np.uint64((1 << hash_bits) - 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            _, grams, owner, base, _, pick = _windows(batch["text"], window, gram, mask)
            new = np.ones(len(pick), bool)
            new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[pick[new]].view(np.int64)), batch["id"].take(pa.array(owner[new])), pa.array((pick - base)[new].astype(np.int32))], names=["anchor", "id", "at"]
            )

    found = rows.mapInArrow(anchors, "anchor long, id long, at int")
    # Written before it is joined: with a shuffle of its own on either side of the join, Spark can split a frequent anchor.
    shared = stage(found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "shared")
    seeds = stage(found.join(shared, "anchor").select("id", "at"), "seeds")
    by_doc = seeds.groupBy("id").agg(F.collect_set("at").alias("seeds"))
    discard(shared)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            words, _, owner, base, begin, pick = _windows(batch["text"], window, gram, mask)
            # A seed's key: its text and place.
            parent, at = batch["seeds"].flatten(), batch["seeds"].offsets.to_numpy()
            of = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(at))
            live = np.isin(owner << 40 | pick - base, of << 40 | parent.to_numpy().astype(np.int64))
            hashes = (sequence_hashes(words, window)[begin[live]] & mask).view(np.int64)
            own = pa.array(owner[live])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), batch["id"].take(own), batch["tag"].take(own), pa.array((begin - base)[live].astype(np.int32))], names=["hash", "id", "tag", "start"]
            )

    texts = rows.select("id", text_tag(F.col("text")).alias("tag"), "text")
    window_rows = texts.join(by_doc, "id").mapInArrow(extend, "hash long, id long, tag int, start int")
    # A place is a document and a first word in one number that sorts by id first: a long where ids leave room, else a decimal. No
    # window starts behind the last seed, so places have room for the longest text too.
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    bits = max(START_BITS, (seeds.agg(F.max("at")).first()[0] or 0).bit_length())
    plain = low is None or 0 <= low and high < 1 << (63 - bits)
    kind = "long" if plain else "decimal(38,0)"
    place = F.col("id").cast(kind) * F.lit(1 << bits).cast("long" if plain else "decimal(10,0)") + F.col("start")
    extended = stage(window_rows.select("hash", "tag", place.cast(kind).alias("place")), "extended")
    discard(seeds)
    id_of = (lambda c: F.shiftright(c, bits)) if plain else (lambda c: F.floor(F.col(c) / F.lit(1 << bits).cast("decimal(10,0)")).cast("long"))
    start_of = lambda c: F.pmod(F.col(c), F.lit(1 << bits).cast(kind)).cast("int")
    def pieces(part: int) -> DataFrame:
        """What the windows of one part of the hashes ask for; equal windows have one hash, so they lie in one part."""
        own = extended.where(F.pmod("hash", F.lit(PARTS)) == part)
        classes = own.groupBy("hash").agg(F.min("place").alias("partner"), F.max("place").alias("high"))
        earliest = stage(classes.where(id_of("partner") < id_of("high")).select("hash", "partner"), "earliest")
        release(docs.sparkSession)  # the shuffle that found the classes is as large as the one that comes
        again = own.join(earliest, "hash").where(id_of("place") > id_of("partner"))
        out = stage(again.select(id_of("place").alias("id"), "tag", start_of("place").alias("start"), id_of("partner").alias("low"), start_of("partner").alias("at")), "asked")
        discard(earliest)
        return out

    # Part by part, and written before windows are gathered by text: no more than one part's shuffles lie beside the windows.
    parts = [pieces(part) for part in range(PARTS)]
    discard(extended)
    asked = functools.reduce(DataFrame.unionByName, parts).select("id", "tag", F.struct("start", "low", "at").alias("w"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, fields = lists_of(batch["ws"], "start", "low", "at")
            doc, begin, end, low, at = runs(row, *(f.to_numpy().astype(np.int64) for f in fields), window)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(own), batch["tag"].take(own), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(low), pa.array(at, pa.int32()),
            ], names=["id", "tag", "begin", "end", "low", "at"])

    matches = stage(asked.groupBy("id", "tag").agg(F.collect_list("w").alias("ws")).mapInArrow(match, "id long, tag int, begin int, end int, low long, at int"), "matches")
    discard(*parts)
    return texts, matches, mask


def _brought(texts: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tag, found): for each document its matches with the partners' passages; and the staged passages, which it reads as it does the matches."""
    wanted = matches.groupBy("low").agg(F.collect_set(F.struct("at", (F.col("end") - F.col("begin")).alias("n"))).alias("cuts"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            row, (at, n) = lists_of(batch["cuts"], "at", "n")
            out, words, now = [], [], -1
            for r, a, k in zip(row.tolist(), at.to_pylist(), n.to_pylist()):
                if r != now:
                    words, now = words_of(batch["text"][r].as_py()), r
                out.append(b" ".join(words[a : a + k]))
            yield pa.RecordBatch.from_arrays([batch["low"].take(pa.array(row)), at, n, pa.array(out, pa.binary())], names=["low", "at", "n", "passage"])

    cut = stage(texts.select(F.col("id").alias("low"), "text").join(wanted, "low").mapInArrow(passages, "low long, at int, n int, passage binary"), "passages")
    brought = matches.withColumn("n", F.col("end") - F.col("begin")).join(cut, ["low", "at", "n"])
    release(texts.sparkSession)  # the texts that were cut were shuffled; documents with matches are next
    return brought.groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "end", "passage")).alias("found")), cut


def _settled(texts: DataFrame, checked: DataFrame, window: int, gram: int, mask: np.uint64) -> DataFrame:
    """``checked`` with the windows of doubtful matches decided by their words: all windows of all texts that share a hash with one
    of them are grouped by the words themselves."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _RUN):
            words, _, owner, base, begin, _ = _windows(batch["text"], window, gram, mask)
            hashes, own = (sequence_hashes(words, window)[begin] & mask).view(np.int64), pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch["id"].take(own), batch["tag"].take(own), pa.array((begin - base).astype(np.int32))], names=["hash", "id", "tag", "start"])

    held = "hash long, id long, tag int, start int"
    starts = F.explode(F.expr(f"flatten(transform(doubts, m -> sequence(m.begin, m.end - {window})))")).alias("start")
    doubtful = checked.where("size(doubts) > 0").select("id", "tag", starts).distinct()
    own = texts.join(doubtful.select("id", "tag").distinct(), ["id", "tag"], "left_semi").mapInArrow(hashed, held)
    hashes = stage(own.join(doubtful, ["id", "tag", "start"], "left_semi").select("hash").distinct(), "doubtful")
    members = texts.mapInArrow(hashed, held).join(hashes, "hash", "left_semi").groupBy("id", "tag").agg(F.collect_set("start").alias("starts"))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, tag, text, at in zip(batch["id"], batch["tag"], batch["text"], batch["starts"]):
                words = words_of(text)
                yield pd.DataFrame([(b" ".join(words[s : s + window]), doc, tag, s) for s in at], columns=["words", "id", "tag", "start"])

    told = stage(texts.join(members, ["id", "tag"]).mapInPandas(spelled, "words binary, id long, tag int, start int"), "spelled")
    least = told.groupBy("words").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("words", "low")
    more = told.join(least, "words").where("id > low").groupBy("id", "tag").agg(F.collect_set("start").alias("more"))

    @F.pandas_udf(_SPANS)
    def joined(spans: pd.Series, more: pd.Series) -> pd.Series:
        both = zip(spans, more)
        made = [merged([(x["begin"], x["end"]) for x in (a if a is not None else ())] + [(int(s), int(s) + window) for s in (b if b is not None else ())]) for a, b in both]
        return pd.Series([[{"begin": a, "end": b} for a, b in x] for x in made])

    none = F.lit(None).cast(_SPANS)
    out = stage(checked.join(more, ["id", "tag"], "full").select("id", "tag", joined("spans", "more").alias("spans"), none.alias("doubts")), "settled")
    discard(told, hashes, checked)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hash_bits: int = 64) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed and repeats (array of [begin, end) words) added; columns of ``docs`` with these
    names are replaced.

    Each word is removed that a window of ``window`` words covers which also starts in a document with a smaller id; windows
    are judged on the input. Null and empty texts have no words and give an empty kept_text. A null id counts as the smallest.
    Rows that share an id don't remove each other's words; of rows that share both id and CRC-32 of the text, which equal rows
    do, each gets the repeats found. An empty table gives an empty result. Texts have at most 2^25 words.
    """
    made = ("kept_text", "n_words", "n_removed", "repeats")
    held = [c for c in docs.columns if c not in made]
    text = F.col(f"row.{text_col}")
    keyed = docs.select(F.struct(*held).alias("row")).withColumns({"id": F.coalesce(F.col(f"row.{id_col}").cast("long"), F.lit(FIRST)), "tag": text_tag(text)})
    texts, matches, mask = _matches(docs, id_col, text_col, window, gram, hash_bits)
    each, passages = _brought(texts, matches)

    @F.pandas_udf(f"kept_text string, n_words long, n_removed long, repeats {_SPANS}, doubts {_SPANS}")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch[0]), _ROWS):  # a part at a time: a worker holds no second copy of a batch
                out = []
                for text, begin, end, *passage in zip(*(column.iloc[low : low + _ROWS] for column in batch)):
                    words, kept, at = words_of(text), [], 0
                    if passage:
                        spans, doubts = verdict(words, begin, end, *passage)
                    else:
                        spans, doubts = [] if begin is None else list(zip(begin.tolist(), end.tolist())), []
                    for a, b in spans:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    left = b" ".join(kept).decode("utf-8", "surrogatepass")
                    out.append((None if left == text else left, len(words), len(words) - len(kept), listed(spans), listed(doubts)))
                yield pd.DataFrame(out, columns=[*made, "doubts"])
            give_back()

    # A text meets its passages once, and is compared and cut there. What stays as it was isn't written twice.
    done = keyed.join(each, ["id", "tag"], "left").select("id", "tag", "row", cut(text, "found.begin", "found.end", "found.passage").alias("cut"))
    cuts = stage(done, "cut")
    discard(matches, passages)
    if not cuts.where("size(cut.doubts) > 0").isEmpty():
        checked = cuts.select("id", "tag", F.col("cut.repeats").alias("spans"), "cut.doubts").where("size(spans) + size(doubts) > 0").dropDuplicates(["id", "tag"])
        found = _settled(texts, stage(checked, "checked"), window, gram, mask)
        cuts = keyed.join(found, ["id", "tag"], "left").select("row", cut(text, "spans.begin", "spans.end").alias("cut"))
    return cuts.select("row.*", F.coalesce("cut.kept_text", text).alias("kept_text"), *[f"cut.{c}" for c in made[1:]])
