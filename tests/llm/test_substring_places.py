"""Places of windows in texts that are longer than the usual room for them."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import substring_dedup as S


@pytest.mark.parametrize("low", [0, -5])
def test_long_texts_have_room(spark, monkeypatch, low):
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        words[700 + 20 * i : 700 + 20 * i] = shared
        rows.append((low + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in S.substring_dedup(docs).collect()}
    assert {(d, n) for d, n, _ in want} == {(low + i, 40 if i else 0) for i in range(6)}
    monkeypatch.setattr(S, "START_BITS", 3)
    assert {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in S.substring_dedup(docs).collect()} == want


def test_shuffles_that_are_done_with_go_before_the_next(spark, monkeypatch):
    from lodestone.llm import substring_dedup as D

    steps, stage, release = [], D.stage, D.release
    monkeypatch.setattr(D, "stage", lambda df, label: steps.append(label) or stage(df, label))
    monkeypatch.setattr(D, "release", lambda session: steps.append("release") or release(session))
    text = " ".join(f"w{i}" for i in range(40))
    found = {r["id"]: r["spans"] for r in D.repeats(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")).collect()}
    assert [(s["begin"], s["end"]) for s in found[2]] == [(1, 41)] and steps.index("earliest") < steps.index("release") < steps.index("matches")


def test_windows_are_gone_before_they_are_gathered_by_text(spark, monkeypatch):
    import os

    from lodestone.llm import substring_dedup as D

    stage, made = D.stage, []

    def watched(df, label):
        if label == "matches":
            assert [x for x, _ in made].count("asked") == D.PARTS > 1
            assert not [x for x, path in made if x in ("extended", "earliest") and os.path.exists(path.removeprefix("file://"))]
        out = stage(df, label)
        made.append((label, out._staged_path))
        return out

    monkeypatch.setattr(D, "stage", watched)
    # Texts of more rows than a part of a batch; every second one repeats a passage.
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} " + (passage if i % 2 else f"b{i}") + f" c{i}") for i in range(1100)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in D.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want = {i: (32 if i % 2 else 3, 30 if i % 2 and i > 1 else 0, f"a{i} c{i}" if i % 2 and i > 1 else text) for i, text in rows}
    assert got == want


def test_a_worker_keeps_little_after_hashing_words():
    import tracemalloc

    import pyarrow as pa

    from lodestone.llm import words as W

    W._powers.cache_clear()
    tracemalloc.start()
    hashes = W.string_hashes(pa.array([f"word {i}" for i in range(50_000)] + ["x" * 200_000, "x" * 200_001]))
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 50_002 and kept < 16e6


def test_a_text_is_compared_and_cut_where_it_meets_its_passages(spark, monkeypatch):
    steps, stage = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df, label: steps.append(label) or stage(df, label))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, f"a  {passage} b"), (2, f"a  {passage} b"), (3, "x  y"), (4, None), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.substring_dedup(docs)
    assert steps[-2:] == ["passages", "cut"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(1, passage, 20, 0), (2, "a b", 22, 20), (2, "a b", 22, 20), (3, "x y", 2, 0), (4, "", 0, 0), (5, "", 20, 20)]
    assert sorted((r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in got.collect()) == want
    # With few bits hashes collide: what differs is settled by its words, with the same result.
    again = S.substring_dedup(docs, hash_bits=3)
    assert sorted((r["doc_id"], r["kept_text"], r["n_words"], r["n_removed"]) for r in again.collect()) == want and "settled" in steps
