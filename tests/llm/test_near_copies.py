"""The near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline as P


def shingles(text):
    w = (text or "").encode().lower().split()  # ASCII, as the stage
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Ids that stay, and all pairs of unequal ids with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(i, j) for i in ids for j in ids if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return {i for i in ids if low[i] == i}, pairs


def fixture():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, i = [], 0
    for n in (1, 3, 5, 9, 30, 80, 200, 200, 200, 400):
        base = [word() for _ in range(n)]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            copy = [word() if rng.random() < share else w for w in base]
            rows.append((i, "  ".join(copy).upper() if i % 3 == 0 else " ".join(copy)))
            i += 1
    footer = [f"footer{k}" for k in range(60)]
    for _ in range(40):
        rows.append((i, " ".join([word() for _ in range(40)] + footer)))
        i += 1
    return [*rows, (i, ""), (i + 1, None), (i + 2, " \n")]


def test_near_copies_against_all_pairs(spark):
    rows = fixture()
    stays, pairs = brute_kept(rows)
    got = {r.doc_id for r in P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(pairs) > 100 and got == stays


def test_near_copies_on_documents(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stays, _ = brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, SF).select("doc_id").collect()} == stays


def test_pairs_carry_folded_sketches_before_whole_ones(spark, monkeypatch):
    """Long texts, whose small sketches tell little: what folded ones exclude never meets a whole one, and no similar pair is excluded."""
    from lodestone.llm import near_copies as N

    rng = random.Random(6)
    rows = []
    for i in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:1450] + [f"v{rng.randrange(10**6)}" for _ in range(50)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    measured = N._measured(docs, "doc_id", "text")
    of = {r["id"]: r["digest"] for r in measured.select("id", "digest").collect()}
    pairs = spark.createDataFrame([(of[a], of[b]) for a in of for b in of if a < b], "src long, dst long")
    sizes, stage = {}, N.stage

    def watched(df, label):
        out = stage(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(N, "stage", watched)
    got = {tuple(r) for r in N._likely(pairs, measured.select("digest", "odd", "n")).collect()}
    assert got == {(of[2 * i], of[2 * i + 1]) for i in range(12)} and sizes["rough"] < 30
