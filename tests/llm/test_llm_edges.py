"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat_format, exact_dedup, language_id, language_model, packing, quality_classifier, quality_rules, simhash, substring_dedup
from lodestone.llm.queries import tokenizer_file
from lodestone.operators.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id string, id string, n_words string, score string, tag string, row string, ids string, label string"
LONG = " ".join(f"word{i % 977}" for i in range(120_000))
TEXTS = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "same text"), (None, "same text"), (3, "another one"), (5, LONG), (6, " \n\t "), (7, "!!! 123"), (8, LONG + "x"), (9, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", 0, *["clash"] * 9) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(odd, none):
    got = exact_dedup.exact_groups(odd, first=4, growth=3).toPandas()
    assert len(got) == len(TEXTS)
    same = got[got.group_size == 4]
    assert set(same.keep_id) == {4} and same.kept.sum() == 1 and len(got[got.group_size == 2]) == 2
    assert got.kept.sum() == len({t or "" for _, t in TEXTS})
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == got.kept.sum()
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


def test_exact_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (0, "a"), (3, "a" * 70), (4, "a" * 64)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(df).collect()) == [(1, "a"), (2, "b"), (2, "c"), (3, "a" * 70), (4, "a" * 64)]


def test_bpe(odd, none):
    path = tokenizer_file()
    both = odd.select("text", bpe.encode("text", path).alias("ids")).withColumn("back", bpe.decode("ids", path)).toPandas()
    assert all(b == (t or "") for t, b in zip(both.text.where(both.text.notna(), ""), both.back)) and len(both.ids[0]) == 0
    assert bpe.encode_documents(none, path).count() == 0


@pytest.fixture(scope="module")
def merges():
    """A small random merge list over a, b, c."""
    rng = random.Random(11)
    vocab, pairs = {c: i for i, c in enumerate(bpe.byte_alphabet())}, []
    tokens = ["a", "b", "c"]
    while len(pairs) < 60:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in vocab and len(a + b) <= 7:
            vocab[a + b] = len(vocab)
            tokens.append(a + b)
            pairs.append((a, b))
    return bpe.MergeTable.of(vocab, pairs)


def plain_merge(table, data):
    tokens = [int(table.byte_id[b]) for b in data]
    while True:
        ranks = [table.pairs.get(p, (10**9,))[0] for p in zip(tokens, tokens[1:])]
        if not ranks or min(ranks) == 10**9:
            return tokens
        k = ranks.index(min(ranks))
        tokens[k : k + 2] = [table.pairs[tokens[k], tokens[k + 1]][1]]


@settings(max_examples=150, deadline=None)
@given(data=st.binary(max_size=300).map(lambda x: bytes(97 + b % 3 for b in x)), cut=st.integers(1, 40))
def test_lookahead_settles_boundaries(merges, data, cut):
    whole = plain_merge(merges, data)
    machine = bpe.Transducer(merges)
    out = []
    for k in range(0, len(data), cut):
        out.extend(machine.feed(data[k : k + cut]))
        assert len(machine.held) <= machine.window + cut
    assert [*out, *machine.finish()] == whole == merges.merge_window(data)
    tokens, begin, size = merges.merge_many([data])
    assert tokens[begin[0] : begin[0] + size[0]].tolist() == whole


@settings(max_examples=80, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(list("ab'stre \n\t.,1é日 ")), st.characters(codec="utf-8")), max_size=60))
def test_bpe_equals_library_on_any_text(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    text += "<|endoftext|>" if len(text) % 5 == 0 else ""
    ids = next(iter(bpe.encoded(tokenizer_file(), [text]))).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_every_token_comes_from_the_transducer():
    encoder = bpe.Encoder(bpe.MergeTable(tokenizer_file()))
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(n)) for n in (3, 200, 300, 1000, 1500, 5000) for _ in range(5)})
    ids, ends = encoder.batch(words)
    assert encoder.machine.emitted == len(ids) == ends[-1]
    encoder.batch([w for w in words if len(w.encode()) <= encoder.SHORT])
    assert encoder.machine.emitted == len(ids)  # remembered, each once


@pytest.mark.parametrize("chunk", [16, 23, 64])
def test_chunks_of_a_long_text_change_nothing(chunk):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokenizer_file()), random.Random(chunk)
    table = bpe.MergeTable(tokenizer_file())
    for _ in range(150):
        text = "".join(rng.choice("ab'stre \n\t.,1é日lvd!' ") * rng.choice([1, 1, 1, 70]) for _ in range(60))
        assert bpe.Encoder(table, chunk=chunk).batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_equal_library():
    from tokenizers import Tokenizer

    library, rng, encoder = Tokenizer.from_file(tokenizer_file()), random.Random(1), bpe.Encoder(bpe.MergeTable(tokenizer_file()))
    for n in (200, 300, 1000, 1300, 5000):
        for letters in ("ab", "etaoinshr", "éa日"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert encoder.batch([word])[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_long_text_needs_constant_memory():
    import tracemalloc

    encoder = bpe.Encoder(bpe.MergeTable(tokenizer_file()), chunk=1 << 16)
    encoder.batch(["some words to begin with " * 4000])
    peaks = []
    for n in (40_000, 160_000):
        text = "some words that go on and on. " * n
        tracemalloc.start()
        ids = encoder.batch([text])[0]
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * ids.nbytes)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (4 << 20)


def test_decoder_holds_back_incomplete_characters(merges):
    table = bpe.MergeTable(tokenizer_file())
    ids = [int(table.byte_id[b]) for b in "é日".encode()]
    machine = bpe.StreamDecoder(table)
    assert [machine.feed([i]) for i in ids] == ["", "é", "", "", "日"] and machine.finish() == ""
    assert machine.feed(ids[:1]) + machine.finish() == "�"


def test_language(spark, odd, none):
    model = language_id.train(odd)
    got = odd.select("text", language_id.predict(spark, model, F.col("text")).alias("p")).select("text", "p.*").collect()
    assert {r["text"]: r["lang"] for r in got}[None] == "und" and {r["lang"] for r in got} == {"en", "und"}
    assert all(r["score"] == 0 for r in got if r["lang"] == "und")
    wide = language_id.hashed_grams([LONG], (1, 2, 3), 1 << 16)[0]
    cut = np.concatenate([r[2] for r in language_id.gram_runs([LONG], (1, 2, 3), 1 << 16, 1000)])
    assert (np.sort(wide) == np.sort(cut)).all()
    empty = language_id.train(none)
    assert {r[0]["lang"] for r in odd.select(language_id.predict(spark, empty, F.col("text"))).collect()} == {"und"}
    with pytest.raises(ValueError):
        language_id.train(odd, most_bytes=1000)


def bayes_by_hand(texts, langs, orders=(1, 2, 3), buckets=1 << 16, smoothing=0.5):
    """Language and posterior of each text, by plain loops over n-grams."""
    from collections import Counter
    from math import exp, log

    def buckets_of(text):
        text = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
        kept = [c for k, c in enumerate(text) if c != " " or k == 0 or text[k - 1] != " "]
        for n in orders:
            for k in range(len(kept) - n + 1):
                gram = kept[k : k + n]
                if any(c != " " for c in gram):
                    code = 0
                    for c in gram:
                        code = (code * 0x100000001B3 + ord(c)) % 2**64
                    yield ((code + n) * 0x9E3779B97F4A7C15 % 2**64 >> 32) % buckets

    counts, totals, docs = {}, Counter(), Counter()
    for t, g in zip(texts, langs):
        if g is not None:
            counts.setdefault(g, Counter()).update(buckets_of(t))
            docs[g] += 1
    for g in counts:
        totals[g] = sum(counts[g].values())
    out = []
    for t in texts:
        grams = list(buckets_of(t))
        logs = {g: log(docs[g] / sum(docs.values())) + sum(log((counts[g][b] + smoothing) / (totals[g] + smoothing * buckets)) for b in grams) for g in counts}
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(exp(x - logs[best]) for x in logs.values())) if any(c.isalpha() for c in t) else ("und", 0.0))
    return out


def test_language_against_plain_loops(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").limit(60).toPandas()
    texts = [*(t[:400] for t in rows.text.fillna("")), "", "123 !", "Ünïcode ǅ ß İ", "a"]
    langs = [*rows.lang, None, "en", None, None]
    frame = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(zip(texts, langs))], "k int, text string, lang string")
    got = frame.select("k", language_id.predict(spark, language_id.train(frame), F.col("text")).alias("p")).orderBy("k").select("p.*").collect()
    for r, (lang, score) in zip(got, bayes_by_hand(texts, langs)):
        assert r["lang"] == lang and r["score"] == pytest.approx(score, abs=1e-9)


def test_gibberish_and_unlearned_languages_do_not_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = language_id.train(docs), random.Random(1)
    fit = lambda frame: [r[0] for r in frame.select(language_id.predict(spark, model, F.col("text")).alias("p")).select("p.fit").collect()]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (60, 200, 2000)]
    junk += ["Это предложение написано на русском языке", "Jutro pójdziemy do kina, żeby zobaczyć nowy film", "Het is een mooie dag en wij gaan naar het strand om te zwemmen met de kinderen"]
    assert max(fit(spark.createDataFrame([(t,) for t in junk], "text string"))) < -1.5
    assert min(fit(docs)) > -1.5


def test_language_model(odd, none):
    got = language_model.score(odd, odd).toPandas()
    assert len(got) == len(TEXTS) and sorted(got.n_tokens)[:3] == [1, 1, 1] and (got.n_known == got.n_tokens).all()
    assert np.isfinite(got[["base_score", "score"]]).all().all()
    untaught = language_model.score(odd, none).toPandas()
    assert (untaught.n_known == 0).all() and (untaught.train_tokens == 0).all()
    assert language_model.score(none, odd).count() == 0


def test_filter_is_never_too_low():
    own = language_model.Settings()
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1)), rng.integers(1, 400, 3000)
    segments = 4
    held = {s: language_model.filled(language_model.short(keys[p], segments), counts[p], own) for s, p in language_model.by_segment(keys, segments)}
    told = language_model.LogFrequencyFilter(held, segments, own)
    level, want = language_model.levels(np.maximum(told.counts(keys), 1), own.log_base), language_model.levels(counts, own.log_base)
    assert (level >= want).all() and (level == want).mean() > 0.97
    assert (told.counts(rng.integers(0, 2**63, 3000).astype(np.uint64)) == 0).mean() > 0.97


def test_language_model_either_way(spark, odd, none):
    """A filter over the bound stays a table; scores are those of one that is broadcast, at any number of partitions."""
    small = language_model.Settings(most_bits=0, share=64)
    for docs, train in ((odd, odd), (odd, none), (none, odd)):
        sent = language_model.score(docs, train, settings=language_model.Settings(share=64)).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        try:
            kept = language_model.score(docs, train, settings=small).toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        order = ["doc_id", "n_tokens", "score"]
        assert len(sent) == len(kept) and np.allclose(sent.sort_values(order).score, kept.sort_values(order).score, rtol=1e-12)


def test_rules(spark, odd, none):
    got = quality_rules.ledger(odd).toPandas()
    assert len(got) == len(TEXTS) and got[got.doc_id == 1].n_words.tolist() == [0]
    assert got[got.doc_id == 5].n_words.tolist() == [120_000] and got[got.doc_id == 5].n_repeat_words.tolist() == [120_000]
    one = quality_rules.measure(spark.createDataFrame([(1, "a b c d e x a b c d e a b c d e\nq\nq\n \n ")], "doc_id long, text string")).first()
    assert (one["n_repeat_words"], one["n_dup_lines"], one["n_words"]) == (15, 1, 18)
    assert quality_rules.ledger(none).count() == 0
    ablated = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablation(quality_rules.ledger(odd), "v1").collect()}
    assert ablated["few_words"][0] == 10 and set(ablated) == set(quality_rules.BASE)
    assert {r["n_failed"] for r in quality_rules.ablation(quality_rules.ledger(none), "v1").collect()} == {0}


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, perspective string, header string"
    rows = [(1, t, r, x, "c", "c") for t, r, x in ((0, "system", "s"), (1, "ann", "hi"), (2, "bob", None), (3, None, "who"), (3, None, "who"), (None, "ann", "first"))] + [(None, 0, "ann", "lone", "c", "c"), (2, 0, "system", "only", "c", "c")]
    got = chat_format.rotate_perspectives(spark.createDataFrame(rows, schema), block=2).toPandas()
    assert len(got) == 6 * 3 + 1
    for (_, who), part in got[got.conv_id == 1].groupby(["conv_id", "perspective"]):
        part = part.sort_values("position")
        text = "".join(part.rendered)
        assert part.char_start.tolist() == [0, *part.char_end[:-1]] and part.char_end.iloc[-1] == len(text)
        masks = [text[a:b] for a, b in zip(part.mask_start, part.mask_end) if b > a]
        assert all(m.endswith("<|im_end|>") for m in masks) and len(masks) == {"ann": 2, "bob": 1, "unknown": 2}[who]
        assert "user name=" + who not in text and text.startswith("<|im_start|>")
    assert chat_format.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_substring(odd, none):
    got = substring_dedup.substring_dedup(odd).toPandas()
    assert len(got) == len(TEXTS) and set(odd.columns) <= set(got.columns)
    assert got[got.doc_id == 5].n_removed.tolist() == [120_000 - 120_000] and got[got.doc_id == 8].n_removed.tolist()[0] >= 119_980
    assert got[got.doc_id == 2].kept_text.tolist() == [""] and substring_dedup.substring_dedup(none).count() == 0


def removed_by_words(texts):
    """Kept words and number removed, by comparing all windows of 13 words."""
    first = {}
    for i, t in texts:
        w = t.split()
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in texts:
        w = t.split()
        gone = {s + k for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for k in range(13)}
        out[i] = (" ".join(x for k, x in enumerate(w) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("hash_bits", [64, 9, 6])  # with few bits most windows collide
@pytest.mark.parametrize("seed, base", [(3, 0), (4, -20), (5, 1 << 50)])
def test_substring_against_windows(spark, seed, base, hash_bits):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(6)]
    texts = [(base + i, " ".join(rng.choices(pool, k=3) + [rng.choice("xyz")] * rng.randrange(3))) for i in range(14)]
    want = removed_by_words(texts)
    for r in substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"), hash_bits=hash_bits).collect():
        assert (r["kept_text"], r["n_removed"]) == want[r["doc_id"]] and sum(e - b for b, e in r["repeats"]) == r["n_removed"]


def test_substring_tells_words_apart_that_collide_in_a_ring(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2^64, whatever the base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    made = lambda w: " ".join([*(f"u{i}" for i in range(6)), w, *(f"v{i}" for i in range(6))])
    rows = [(1, made(word)), (2, made(word.translate(str.maketrans("ab", "ba")))), (3, made(word))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: 0, 3: 13}


def test_substring_hot_passage(spark):
    """One passage in every document, its neighbours unequal."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(i, f"a{i} b{i} {passage} c{i} d{i % 3}") for i in range(300)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {i: 40 if i else 0 for i, _ in texts}


def test_packing(odd, none):
    got = packing.pack(odd, tokenizer_file(), open_windows=2, fan_in=2).toPandas()
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 1024 and got.ids_crc32.between(0, 2**32 - 1).all() and len(got[got.start == 0]) == len(TEXTS)
    assert packing.pack(none, tokenizer_file()).count() == 0


def test_packing_keeps_large_ids_beside_a_null(spark):
    ids = [2**53 + 1, None, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack(df, tokenizer_file()).collect()} == set(ids)


def test_packing_in_slices(spark, monkeypatch):
    """A batch of texts is packed a slice at a time, to the same pieces."""
    texts = [(i, None if i % 7 == 0 else f"text {i} " * (i % 400)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    order = ["sequence_id", "offset"]
    whole = packing.pack(df, tokenizer_file()).toPandas().sort_values(order, ignore_index=True)
    monkeypatch.setattr(packing, "_RUN", 1000)
    assert packing.pack(df, tokenizer_file()).toPandas().sort_values(order, ignore_index=True).equals(whole)
    assert set(whole.doc_id) == set(range(300)) and whole.length.sum() == whole[whole.start == 0].doc_tokens.sum()


def test_character_kinds_in_little_memory():
    """Every Python worker makes them once, and it keeps room for what it once held."""
    import tracemalloc

    tracemalloc.start()
    kinds = bpe._kinds.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    assert [kinds[ord(c)] for c in " aé日٣!"] == [0, 1, 1, 1, 2, 3] and set(kinds[0xD800:0xE000]) == {3} and len(kinds) == 0x110000 and kinds[0x1D7CE] == 2


def test_open_windows_place_best_fit():
    w = packing.OpenWindows(10, 2, iter(range(100)))
    assert [w.place(n) for n in (6, 7, 3, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0)]


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (1, 2, 3, 4, 5)] + [(7, 9, "x"), (8, None, "x"), (1, 0, "x"), (None, 1, "x")], "doc_id long, quality int, score string")
    got = quality_classifier.score_quality(odd, labels, F.col("doc_id") > 0).toPandas()
    assert len(got) == len(TEXTS) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert set(quality_classifier.score_quality(odd, labels.limit(0), F.col("doc_id") > 0).toPandas().score) == {0.5}
    assert quality_classifier.score_quality(none, labels, F.col("doc_id") > 0).count() == 0


def test_classifier_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit_table(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_classifier_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.random((400, len(quality_classifier.FEATURES)))
    model = quality_classifier.fit_table(x, (x[:, 2] + x[:, 3] > 1).astype(float))
    for row, got in zip(x[:40], model.score(x[:40])):
        place = lambda edges, v: sum(v >= e for e in edges)
        total = model.intercept + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, row))
        total += sum(t[place(model.coarse[i], row[i]), place(model.coarse[j], row[j])] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("seed", range(4))
def test_pair_tree_takes_the_best_pair_of_cuts(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=(5, 6)), rng.random((5, 6)) + 2
    quarters = lambda k, j: [np.s_[:k, :j], np.s_[:k, j:], np.s_[k:, :j], np.s_[k:, j:]]
    gain = lambda parts: sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts)
    best = max((quarters(k, j) for k in range(1, 6) for j in range(1, 7)), key=gain)
    want = np.zeros_like(g)
    for part in best:
        want[part] = g[part].sum() / (h[part].sum() + 1)
    assert np.allclose(quality_classifier._shallow_pair(g, h), want)


def test_ledger_with_other_rules(spark):
    rules = {"tiny": "n_words < 3", "loud": "n_upper > 2"}
    rows = spark.createDataFrame([(1, "a b"), (2, "AAA b c d"), (3, "AAA")], "doc_id long, text string")
    made = quality_rules.ledger(rows, rules=rules)
    policies = {"p": ("tiny", "loud"), "q": ("loud",)}
    assert {r.doc_id: r.ok for r in made.select("doc_id", quality_rules.passes("q", rules=rules, policies=policies).alias("ok")).collect()} == {1: True, 2: False, 3: False}
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablation(made, "p", rules, policies).collect()}
    assert got == {"tiny": (2, 1, 1), "loud": (2, 1, 1)}


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == len(TEXTS) and set(got[got.fp == 0].component_id) == {1}
    assert simhash.near_dedup(odd).columns == odd.columns and simhash.near_duplicates(none).count() == 0 and simhash.near_dedup(none).count() == 0


@pytest.mark.parametrize("most_paired", [1, 4, 1000])
def test_links_lose_nothing(spark, most_paired):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            for _ in range(rng.randrange(3)):
                at ^= 1 << rng.randrange(64)
            prints.add(at - (1 << 64) if at >> 63 else at)
    prints = sorted(prints)
    low = {p: p for p in prints}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    while True:
        moved = False
        for p in prints:
            least = min(low[q] for q in prints if near(p, q))
            moved |= least < low[p]
            low[p] = least
        if not moved:
            break
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), most_paired=most_paired)
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {p: found.get(p, p) for p in prints} == low
    assert all(near(r["src"], r["dst"]) for r in links.collect())


def test_pivots_discard_what_meets_in_vain(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(63) for _ in range(6000)}
    rows = spark.createDataFrame([(p,) for p in prints | {p ^ 3 for p in list(prints)[:50]}], "fp long")
    met = simhash.met_pairs(simhash.meetings(rows, references=3), references=3).toPandas().drop_duplicates(["src", "dst"])
    apart = np.bitwise_count(met.src.to_numpy() ^ met.dst.to_numpy())
    left = met[met.apart <= 2]
    assert (met.apart.to_numpy() <= apart).all() and (apart[(met.apart <= 2).to_numpy()] <= 2).sum() >= 50
    assert len(met) > 500 and len(left) < 0.2 * len(met)  # the table prunes, and loses none


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "other words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(rows).collect()) == [1, 3]
