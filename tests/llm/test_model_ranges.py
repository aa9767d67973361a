"""Probes of the language model by ranges of segments: the same scores, and rows that stay long at any number of segments."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import language_model as L


@pytest.mark.parametrize("ranges", [1, 2, 512])
def test_same_scores(spark, ranges):
    texts = [" ".join(f"w{(i * k) % 61}" for k in range(1, 40 + i)) for i in range(60)] + [None, "", "w1 w1 w1"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    one = L.score(docs, docs, settings=L.Settings(share=32)).toPandas().sort_values("doc_id")
    other = L.score(docs, docs, settings=L.Settings(share=32, most_bits=0, ranges=ranges)).toPandas().sort_values("doc_id")
    assert np.allclose(one.score, other.score, rtol=1e-12) and one.n_known.tolist() == other.n_known.tolist()


def test_each_text_follows_its_quantised_counts(spark):
    """A score is the sum over tokens of the logarithm of the model's chance, from counts rounded to levels."""
    texts = ["a b a b c", "b a", "a a a a", "new words here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = L.Settings()
    got = {r["doc_id"]: r["score"] for r in L.score(docs, docs.where("doc_id < 3")).collect()}
    train = [t.split() + [""] for t in texts[:3]]
    words, pairs = {}, {}
    for t in train:
        for v, w in zip(["", *t], t):
            words[w], pairs[v, w] = words.get(w, 0) + 1, pairs.get((v, w), 0) + 1
    total = sum(words.values())
    scale = total + 0.5 * (len(words) + 1)
    rounded = lambda c: float(L.counts_of(L.levels(np.array([c]), own.log_base), own.log_base)[0]) if c else 0.0
    for i, t in enumerate(texts):
        t, score = t.split() + [""], 0.0
        for v, w in zip(["", *t], t):
            past = words.get(v, 0)
            score += np.log10((min(rounded(pairs.get((v, w), 0)), past) + own.prior * (words.get(w, 0) + 0.5) / scale) / (past + own.prior))
        assert got[i] == pytest.approx(score, rel=1e-9)


def test_bytes_of_a_key():
    """Alike within a fifth at 8, 512 and 32,768 segments, row overhead included."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2))
    cost = []
    for segments in (8, 512, 32_768):
        r = L.Ranges(segments, 512)
        rows = r.rows(keys)
        assert len(rows) <= 512
        cost.append((sum(len(b) for _, b in rows) + 48 * len(rows)) / len(keys))
        back = [(s, k) for number, blob in rows for s, part in r.apart(number, blob) for k in L.unpacked_keys(part).tolist()] if segments > 512 else None
        if back:
            assert back == list(zip(L.segment_of(keys, segments).tolist(), L.short(keys, segments).tolist()))
    assert max(cost) < 1.25 * min(cost), cost
