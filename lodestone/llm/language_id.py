"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over the training texts: each task sums hashed n-grams by language in numpy and hands on its nonzero
cells, which Spark adds up. The model is a matrix of ``buckets`` x languages log probabilities; its size is checked before any
cell comes to the driver. Scoring looks up the matrix at the n-grams of a whole batch of texts and sums by text; very long texts
are read in slices.

A posterior only says which learned language is likelier than the others, and tends to 1 with a text's length whatever the text
is. So a prediction also has its fit: the mean log probability of the text's n-grams in its language, less what that
language's own texts have, in units that don't grow with the text. Gibberish and languages that weren't learned fall far below 0.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import text_runs
from lodestone.llm.words import give_back

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, log prior of each, log probabilities (buckets x languages), the n-gram lengths, and mean and variance of
    the log probability of an n-gram in each language's own texts."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray
    orders: tuple[int, ...]
    own_mean: np.ndarray
    own_variance: np.ndarray


@functools.cache
def _fold() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class _Tail:
    """What the next slice of a text needs of those before: the last code points kept, whether each is a letter, and whether the
    last of all is one."""

    points: np.ndarray
    letter: np.ndarray
    last: bool


def hashed_grams(texts: list[str], orders: tuple[int, ...], buckets: int, tail: _Tail | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Tail]:
    """Bucket and text number of every n-gram, whether each text has a letter, and the tail for a next slice of a single text.

    Runs of non-letters count as one space; a space may begin or end an n-gram but not make up one alone.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = points != 32
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[letter]] = True
    none = np.empty(0, np.int64)
    if not len(points):
        return none, none, has_letter, tail or _Tail(points, letter, False)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stands for its run
    if tail is None:
        first = np.ones(len(points), bool)
        first[1:] = owner[1:] != owner[:-1]
        keep |= first  # and each text begins with a space or letter of its own
    else:
        keep[0] |= tail.last
    last = bool(letter[-1])
    points, owner, letter = points[keep], owner[keep], letter[keep]
    if tail is not None:
        points, letter = np.concatenate([tail.points, points]), np.concatenate([tail.letter, letter])
        owner = np.zeros(len(points), np.int32)
    known = 0 if tail is None else len(tail.points)
    held = max(orders) - 1
    rest = _Tail(points[max(0, len(points) - held) :], letter[max(0, len(letter) - held) :], last)
    points = points.astype(np.uint64)
    found, owners = [], []
    for n in orders:
        begin = max(0, known - n + 1)  # n-grams that end in what was known are counted already
        end = len(points) - n + 1
        if end <= begin:
            continue
        code, some = points[begin:end].copy(), letter[begin:end].copy()
        for k in range(1, n):
            code = code * np.uint64(0x100000001B3) + points[begin + k : end + k]
            some |= letter[begin + k : end + k]
        whole = some & (owner[begin:end] == owner[begin + n - 1 :])
        code = (code[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append(((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[begin:end][whole])
    return np.concatenate([*found, none]), np.concatenate([*owners, none.astype(np.int32)]), has_letter, rest


def gram_runs(texts: list[str], orders: tuple[int, ...], buckets: int, most_chars: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the first text, number of texts, and what ``hashed_grams`` tells, by runs of texts; a longer text comes in slices."""
    at = 0
    for run in text_runs(texts, most_chars):
        if len(run) == 1 and len(run[0]) > most_chars:
            tail = None
            for k in range(0, len(run[0]), most_chars):
                bucket, owner, has_letter, tail = hashed_grams([run[0][k : k + most_chars]], orders, buckets, tail)
                yield at, 1, bucket, owner, has_letter
        else:
            yield at, len(run), *hashed_grams(run, orders, buckets)[:3]
        at += len(run)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, smoothing: float = 0.5, most_bytes: int = 256 << 20) -> LanguageModel:
    """Fit on all rows whose language is not null; null and letterless texts teach nothing but count for the prior.

    The model has languages x buckets cells; more than ``most_bytes`` of them is an error. No rows give a model without
    languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, cells in sums.items():
                at = np.flatnonzero(cells)
                yield pd.DataFrame({"lang": lang, "bucket": at - 1, "n": cells[at]})
            sums.clear()

        for batch in batches:
            for lang, rows in batch.groupby("lang")["text"]:
                cells = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))  # cell 0: texts
                cells[0] += len(rows)
                for _, _, bucket, _, _ in gram_runs(rows.fillna("").tolist(), orders, buckets):
                    cells[1:] += np.bincount(bucket, minlength=buckets)
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    most = most_bytes // (8 * buckets)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"over {most} languages of {buckets} buckets exceed the {most_bytes} bytes that may be broadcast")
    sums = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = sums.toPandas()
    code = cells["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    at, n = cells["bucket"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    counts, texts = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    grams = at >= 0
    counts[at[grams], code[grams]] = n[grams]
    texts[code[~grams]] = n[~grams]
    with np.errstate(divide="ignore"):
        prob = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
        prior = np.log(texts / max(1.0, texts.sum()))
    share = counts / np.maximum(1.0, counts.sum(axis=0))
    mean = (share * prob).sum(axis=0)
    return LanguageModel(tuple(languages), prior, prob, orders, mean, (share * prob**2).sum(axis=0) - mean**2)


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang, score, fit>: the likeliest language, its posterior probability, and its fit; ``und``, 0 and null for a text that
    is null or has no letter, or when the model has no languages.

    The fit is the mean log probability of the text's n-grams less that of the language's own texts, plus four standard errors of
    a mean of so many n-grams (each letter lies in several); texts of the language stay above about -0.5 at any length.

    The result depends on the text alone; it is marked as not deterministic so that Spark makes it once for each row.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, fit double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        columns = [np.ascontiguousarray(m.log_prob[:, k]) for k in range(len(m.languages))]
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for texts in batches:
            logs, grams, has_letter = np.zeros((len(texts), len(columns))), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for at, n, bucket, owner, letters in gram_runs(["" if t is None else t for t in texts], m.orders, len(m.log_prob)):
                has_letter[at : at + n] |= letters
                grams[at : at + n] += np.bincount(owner, minlength=n)
                for k, c in enumerate(columns):
                    logs[at : at + n, k] += np.bincount(owner, c[bucket], n)
            if not columns:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "fit": np.full(len(texts), np.nan)})
                continue
            total = logs + m.log_prior
            best = total.argmax(axis=1)
            post = np.exp(total - total.max(axis=1, keepdims=True))
            own = np.take_along_axis(logs, best[:, None], axis=1)[:, 0] / np.maximum(1, grams)
            fit = own - m.own_mean[best] + 4 * np.sqrt(len(m.orders) * m.own_variance[best] / np.maximum(1, grams))
            yield pd.DataFrame({
                "lang": names[np.where(has_letter, best, len(columns))], "score": np.where(has_letter, 1 / post.sum(axis=1), 0.0), "fit": np.where(has_letter, fit, np.nan),
            })
            give_back()

    # Else a filter on the prediction goes below it, and every text is judged twice, by two workers for each task.
    return language.asNondeterministic()(text)


def hash_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as bucket 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets, F.lit(0))
