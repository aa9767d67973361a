"""The registered queries against SQL, brute force, a round trip, or held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodestone.llm.queries import llm_oracles, llm_queries, tokenizer_file
from tests.checking import connection, rows
from tests.conftest import SF

Q, SQL = llm_queries(), llm_oracles()
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert rows(Q[name](spark, SF).toPandas()) == rows(connection(SF).execute(SQL[name]).df())


def test_bpe_equals_library(spark, docs, library):
    got = Q["op2_bpe"](spark, SF).toPandas().set_index("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs.itertuples():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert tuple(got.loc[d.doc_id]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_language_held_out(spark, docs):
    got = Q["op3_language_id"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]])
    held = got[got.held_out]
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id])
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_model_against_exact_counts(spark, docs):
    got = Q["op4_language_model"](spark, SF).toPandas().set_index("doc_id")
    text = {d.doc_id: [*words(lower(d.text)), ""] for d in docs.itertuples()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in text}
    single, pair = Counter(), Counter()
    for i, t in text.items():
        if not held[i]:
            single.update(t)
            pair.update(zip(["", *t], t))
    n = sum(single.values())
    scale = n + 0.5 * (len(single) + 1)
    near = []
    for i, t in text.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(t), sum(w in single for w in t), n)
        assert row.base_score == pytest.approx(sum(np.log10((single[w] + 0.5) / scale) for w in t))
        exact = sum(np.log10((pair[v, w] + 8 * (single[w] + 0.5) / scale) / (single[v] + 8)) for v, w in zip(["", *t], t))
        near.append((exact, row.score))
    near = np.array(near)
    assert np.corrcoef(near.T)[0, 1] > 0.999 and abs(near[:, 1].sum() / near[:, 0].sum() - 1) < 0.02
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()  # the model predicts unseen texts better than unigrams do


def test_packing_is_exact_and_tight(spark, docs, library):
    got = Q["op8_packing"](spark, SF).toPandas().sort_values(["doc_id", "start"])
    want = {d.doc_id: np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4") for d in docs.itertuples()}
    at = dict.fromkeys(want, 0)
    for p in got.itertuples():
        piece = want[p.doc_id][p.start : p.start + p.length]
        assert (p.start, p.length, p.ids_crc32, p.doc_tokens) == (at[p.doc_id], len(piece), zlib.crc32(piece.tobytes()), len(want[p.doc_id]))
        at[p.doc_id] += p.length
    assert at == {k: len(v) for k, v in want.items()}
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ordered.offset == ends - ordered.length).all() and ends.max() <= 1024
    total = ordered.groupby("sequence_id").length.sum()
    assert total.sum() / (1024 * len(total)) > 0.95


def test_quality_held_out(spark):
    got = Q["op9_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels)
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def simhash_brute(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_all_pairs(spark, docs):
    got = Q["op10_simhash"](spark, SF).toPandas().set_index("doc_id")
    prints = {d.doc_id: simhash_brute(d.text) for d in docs.itertuples()}
    assert all(got.fingerprint[i] == f"{f:016x}" for i, f in prints.items())
    low = {i: i for i in prints}
    for _ in range(20):
        for i in prints:
            low[i] = min(low[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)
    assert all(got.component_id[i] == low[i] for i in prints)


def test_language_stage_judges_a_text_once(spark):
    """Filtering by a prediction must not make it again below the filter: each evaluation takes a Python worker of its own in every task."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est assis", "fr"), (3, "123", None)], "doc_id long, text string, lang string")
    kept = P.keep_languages(spark, docs, SF)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}


def test_pipeline(spark, docs, library):
    """Against a plain version of its stages on the same input."""
    import corpus_pipeline as P
    from tests.llm.test_near_copies import brute_kept

    junk = [(10**6 + k, t, None, "s", len(t or "")) for k, t in enumerate(["xq zzkv qjwx vvkq zxqj wqkz jxvq kzzq", "Это предложение написано на русском языке", None, "", "!!! 123"])]
    every = spark.read.parquet(f"{SF}/documents.parquet")
    more = every.unionByName(spark.createDataFrame(junk, every.schema))
    told = P.keep_languages(spark, more, SF)
    assert told.columns == every.columns and {r.doc_id for r in told.select("doc_id").collect()} == set(docs.doc_id)  # junk goes, all else stays
    kept = docs.sort_values("doc_id").drop_duplicates("text", keep="last")
    stays, _ = brute_kept([(d.doc_id, d.text) for d in kept.itertuples()])
    kept = kept[kept.doc_id.isin(stays)]
    first: dict[tuple, int] = {}
    text = {d.doc_id: words(d.text) for d in kept.itertuples()}
    for i in sorted(text):
        for s in range(len(text[i]) - 12):
            first.setdefault(tuple(text[i][s : s + 13]), i)
    final = {}
    for d in kept.itertuples():
        w = text[d.doc_id]
        gone = {s + k for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < d.doc_id for k in range(13)}
        final[d.doc_id] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else d.text
    got = P.run(spark, SF).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows, a column more, and an empty table; columns stay as they are."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, tag string, key string"
    rows = [(1, "the words of a text that is long enough to be told", "en", None, None, "x", "x", "x")] * 2 + [(None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "x", "x"), (None, "the words of another text", "en", "s", 1, "x", "x", "x")]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    want = {"language_id": 3, "exact_dedup": 3, "near_dedup": 3, "substring_dedup": 5}
    for name, step in P.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns and step(spark, docs, SF).count() == want[name], name
        assert step(spark, none, SF).count() == 0
    pieces = P.pack_sequences(spark, docs, SF)
    assert pieces.count() == len(rows) and P.pack_sequences(spark, none, SF).count() == 0
