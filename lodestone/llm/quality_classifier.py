"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured in one pass over the texts. The model is fitted by cyclic boosting: round after round each feature in
turn gets a shallow tree over its bins, fitted to what is left of the labels, and all trees of a feature add up to one lookup
table; then pairs of features that still explain the residuals get trees of depth two over their two-way bins, which add up to
one matrix for each pair. A score is the sum of a few table entries.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

FEATURES = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "repeat_share", "distinct_share",
    "line_repeat_share", "line_words", "short_share", "longest_word", "top_word_share", "start_upper_share",
)
def features_of(text: str | None) -> tuple[float, ...]:
    """The FEATURES of a whole text, finite for any text; a text without words has zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    body = "".join(words)
    chars = len(body)
    upper = sum(map(str.isupper, body))
    letters = sum(map(str.isalpha, body))
    digits = sum(map(str.isdigit, body))
    symbols = sum(map(body.count, "#*$%&|<>"))
    marks = sum(map(body.count, ".,;:!?"))
    lines = [x for x in text.split("\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    return (
        float(np.log1p(n)), chars / n, symbols / chars, upper / max(1, letters), digits / chars, marks / n,
        1 - len(set(grams)) / len(grams) if grams else 0.0, len(set(words)) / n ** 0.8, 1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)), sum(len(w) <= 3 for w in words) / n, float(max(map(len, words))), Counter(words).most_common(1)[0][1] / n,
        sum(w[0].isupper() for w in words) / n,
    )


def measured(text: Column | str) -> Column:
    """array<double> of the FEATURES."""

    @F.pandas_udf("array<double>")
    def quality_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(features_of(t)) for t in texts], dtype=object)

    return quality_features(text)


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges by feature, coarse edges for pairs, intercept, a table by feature and a matrix by pair."""

    edges: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    intercept: float
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features, by adding up table entries."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(values) else np.empty(0)


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins: Newton steps by bin, the best split of any leaf each time."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in itertools.pairwise(cuts):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            gl, hl, gr, hr = g[k] - g[a], h[k] - h[a], g[b] - g[k], h[b] - h[k]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
            gain[(hl < least) | (hr < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), int(k[gain.argmax()]))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in itertools.pairwise(cuts):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _shallow_pair(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of depth two over a two-way grid of bins: the cut along the rows and the cut along the columns that together explain
    most, found among all pairs of cuts (a pure interaction shows in no single cut). Without two bins on a side it has one leaf there."""

    def quadrants(x: np.ndarray) -> np.ndarray:
        sums = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        sums[1:, 1:] = x.cumsum(0).cumsum(1)
        up = sums[1:, 1:]  # sums of rows before and columns before each cut; a cut at the end leaves the other side empty
        return np.stack([up, up[:, -1:] - up, up[-1:, :] - up, up[-1, -1] - up[:, -1:] - up[-1:, :] + up])

    g, h = quadrants(gradient), quadrants(weight)
    steps = g / (h + 1)
    k, j = np.unravel_index((g * steps).sum(axis=0).argmax(), gradient.shape)
    out = np.empty(gradient.shape)
    out[: k + 1, : j + 1], out[: k + 1, j + 1 :], out[k + 1 :, : j + 1], out[k + 1 :, j + 1 :] = steps[:, k, j]
    return out


def fit_table(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, most_pairs: int = 6, rate: float = 0.1, leaves: int = 3) -> AdditiveModel:
    """Cyclic boosting on rows of features and labels 0/1; with no rows the model says 0.5, with one label that one nearly."""
    m = x.shape[1]
    edges, coarse = tuple(_edges(x[:, j], bins) for j in range(m)), tuple(_edges(x[:, j], coarse_bins) for j in range(m))
    mean = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(mean / (1 - mean)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    total = np.full(len(y), intercept)
    if not len(y):
        return AdditiveModel(edges, coarse, 0.0, tuple(tables), ())

    def steps(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

    for _ in range(rounds):
        for j in range(m):
            step = rate * _shallow(*steps(at[j], len(tables[j])), leaves, 1.0)
            tables[j] += step
            total += step[at[j]]
    gains = []
    for i, j in itertools.combinations(range(m), 2):
        g, h = steps(wide[i] * (len(coarse[j]) + 1) + wide[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1))
        gains.append((float((g**2 / (h + 1)).sum()), i, j))
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:most_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in pairs:
            cell = wide[i] * table.shape[1] + wide[j]
            g, h = (x.reshape(table.shape) for x in steps(cell, table.size))
            step = rate * _shallow_pair(g, h)
            table += step
            total += step.ravel()[cell]
    return AdditiveModel(edges, coarse, intercept, tuple(tables), tuple(pairs))


def training_sample(rows: DataFrame, label_col: str, features_col: str, id_col: str, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` labelled rows: those with the least hashes of their ids, below a bound set by the number of rows."""
    labelled = rows.where(F.col(label_col).isNotNull())
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    some = labelled if n <= most else labelled.where(draw < int((1 << 30) * 0.98 * most / n)).limit(most)
    got = some.select(F.col(features_col).alias("x"), F.col(label_col).cast("double").alias("y"), draw.alias("d")).toPandas().sort_values("d", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return x, got["y"].to_numpy()


def scored(model: AdditiveModel, features: Column | str) -> Column:
    """double in 0 to 1 from a features column."""

    @F.pandas_udf("double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(model.score(np.stack(rows.to_list())) if len(rows) else np.empty(0))

    return quality_score(features)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score and predicted (1 if score >= 0.5).

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; others, and null, are ignored; of labels that contradict each other the
    mean counts, 0.5 is ignored). Learns from labelled rows for which ``learn_from``, a condition on the id, holds, by a sample
    bounded by ``most``. Null and empty texts get the score of a text with no words. Repeated rows and null ids are scored; a
    null id learns nothing. Other columns are not read.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), measured(F.col(text_col)).alias("features")), "features")
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("m")).where("m <> 0.5")
    known = rows.join(marks, "id").withColumnRenamed("id", id_col).where(learn_from)
    model = fit_table(*training_sample(known.withColumn("label", F.expr("if(m > 0.5, 1, 0)")), "label", "features", id_col, most))
    done = rows.select(F.col("id").alias(id_col), scored(model, "features").alias("score"))
    return done.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
