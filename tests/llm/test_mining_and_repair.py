"""Structure repair, nearest neighbours and collocations against brute force, with odd rows, copies and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import collocations, neighbours, structure_repair
from lodestone.llm.words import string_hashes

# ---- structure repair ----


def cheapest(rows):
    """(cost, audit, lines) of the best repair of rows (class initial, fault, role, text), by trying every edit of every message."""
    best = {"": (0, "", [])}  # by what stands: "", "s", "u", "a" (last initial; "s" only as the first)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if initial in after[state]:
                        put(out, after[state][initial], (cost + 2, audit + "I", lines + [role + ":"]))
        return out

    for initial, fault, role, text in rows:
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            put(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if initial in after[state]:
                put(new, after[state][initial], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
            for named in ("user", "assistant"):
                if named[0] in after[state]:
                    put(new, after[state][named[0]], (cost + 2 + extra, audit + "R", lines + [f"{named}:{text}"]))
        best = new
    return min((way for state, way in inserted(best).items() if state in ("", "a")), key=lambda way: way[:2])


def expected(messages):
    by = defaultdict(list)
    for conv, turn, role, text in messages:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((role[:1], fault, role, text))
        turns = {t for t, _, _ in rows if t is not None}
        counts = Counter(f[1] for f in faults)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit, lines = cheapest(faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(repaired):
    sums = {r["conv"]["id"]: r["sha256"] for r in structure_repair.digests(repaired.messages).collect()}
    rows = repaired.conversations.collect()
    assert len({r["conv"]["id"] for r in rows}) == len(rows)
    return {r["conv"]["id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), sums.get(r["conv"]["id"], hashlib.sha256(b"").hexdigest())) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, at string, part string, conv string, edit string"


def some_messages(seed, n, convs, span):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?\n", "Why? ", ". x", "ünï.", "long " * 400 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "U"]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(span)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed, n, convs, span, parts", [(1, 400, 60, 9, 4), (2, 300, 1, 250, 13), (3, 120, 2, 3, 5)])
def test_repair(spark, seed, n, convs, span, parts):
    messages = some_messages(seed, n, convs, span)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # a conversation lies in several segments
    try:
        repaired = structure_repair.repair(spark.createDataFrame([(*m, *["clash"] * 4) for m in messages], SCHEMA))
        if convs == 1:
            assert repaired.messages.select("part").distinct().count() > 3
        assert found(repaired) == expected(messages)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repair_of_none_and_copies(spark):
    assert found(structure_repair.repair(spark.createDataFrame([], SCHEMA))) == {}
    messages = [(7, 1, "user", "Hi.")] * 1000 + [(7, 2, "assistant", "Yes.")] + [(8, k, "system", "Again.") for k in range(500)]
    assert found(structure_repair.repair(spark.createDataFrame([(*m, *["clash"] * 4) for m in messages], SCHEMA))) == expected(messages)


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 40)), min_size=1, max_size=6), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_powers_and_unrolling(runs, cuts):
    """Matrices of runs equal step by step costs, and segments unroll to what the whole unrolls to."""
    end = np.array(structure_repair.END)
    step = end
    for symbol, length in reversed(runs):
        for _ in range(length):
            step = structure_repair.joined(structure_repair.transition(symbol), step[:, None])[:, 0]
    assert (structure_repair.before(runs, end[:, None])[:, 0] == step).all()
    whole = structure_repair.unrolled(runs, end, 0, True)[0]
    price = {"D": 3, "I": 2, "K": 0, "R": 2}
    rows = [s for s, n in runs for _ in range(n)]
    kept = [s for s, e in zip(rows, whole.replace("I", "")) if e != "D"]
    assert sum(price[e] for e in whole) + sum(s % 2 for s in kept) == step[0]
    names = "sua?"
    assert cheapest([("?" if s == 8 else names[s // 2], "blank" if s == 8 else "truncated" if s % 2 else "", "r", "t") for s in rows])[:2] == (step[0], whole)


# ---- nearest neighbours ----


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 24)), np.repeat(centres[:1], 300, 0), rng.standard_normal((40, 24)) * 50])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(rows[0][0], rows[0][1])] * 2  # repeated rows are candidates of each other
    odd = [(10_000, None), (10_100, [0.0] * 24), (10_200, [float("nan")] + [1.0] * 23), (10_300, [float("inf")] * 24), (10_400, []), (None, rows[5][1]), (10_500, [1.0, 2.0]), (10_600, [None] + [1.0] * 23), (10_700, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + odd], "vec_id long, embedding array<double>, entry string, score double")
    got = neighbours.nearest(df, "vec_id % 50 = 0", k=10, sample=100).toPandas()
    pool = [r for r in rows if any(r[1])] + [(None, rows[5][1])]
    ids, m = np.array([-1 if i is None else i for i, _ in pool]), np.array([v for _, v in pool])
    hit = total = 0
    for at in [i for i, (q, _) in enumerate(pool) if q is not None and q % 50 == 0]:
        d = np.sqrt(((m - m[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:10]
        mine = got[got.query_id == ids[at]]
        if ids[at]:  # query 0 stands three times
            mine = mine.sort_values("rank")
            assert list(mine["rank"]) == list(range(1, 11)) and (np.diff(mine.score) >= 0).all()
            near = {(j, s) for j, s in zip(mine.vec_id.fillna(-1), mine.score.round(9))}
            hit, total = hit + len(near & {(ids[j], round(d[j], 9)) for j in order}), total + 10
    assert hit / total >= 0.95
    assert len(got[got.query_id == 0]) == 30 and set(got[(got.query_id == 0) & (got["rank"] <= 2)].vec_id) == {0}
    copies = got[(got.query_id == 1550)].sort_values("rank")  # ties at distance 0 go to the smallest ids
    assert copies.vec_id.tolist() == list(range(1500, 1510)) and (copies.score == 0).all()
    pair = got[got.query_id.isin([10_500, 10_700])]
    assert len(pair) == 2 and np.allclose(pair.score, np.sqrt(8)) and set(pair.vec_id) == {10_500, 10_700}
    assert len(got) == 10 * (len([1 for q, _ in pool if q is not None and q % 50 == 0])) + 2
    assert neighbours.nearest(df.where("vec_id < 0"), "vec_id % 50 = 0").count() == 0
    few = neighbours.nearest(df.where("vec_id < 4"), "vec_id = 1").toPandas()
    assert len(few) == 5 and set(few.vec_id) == {0, 2, 3}


def test_estimates_within_bounds():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((4000, 48)), rng.standard_normal((20, 48))
    codes, length, agreement = neighbours.coded(x, None, 256, 1)
    planes, scalars = neighbours.quantised(q, None, 256, 1)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    inside, bias = [], []
    for i in range(len(q)):
        d, error = neighbours.estimates(codes, ones, length, agreement, planes[i], scalars[i], 1.9)
        true = ((x - q[i]) ** 2).sum(1)
        inside.append(np.abs(d - true) <= error)
        bias.append(d - true)
    assert np.mean(inside) > 0.92 and abs(np.mean(bias)) < 0.2


# ---- collocations ----


def mined(docs, least, longest=5, top=2000, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if a >= least}
        longer = defaultdict(int)
        for p, a in held.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in held.items():
            if len(p) > 1 and not (p in longer and 100 * longer[p] >= percent * a):
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def some_texts():
    rng = random.Random(8)
    words = ["the", "The", "of", "new", "york", "city", "été", "a b", "ß", "x" * 300]
    texts = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\t", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    return texts + [("new york city hall is new york city hall", "en")] * 30 + [(None, "en"), ("", "fr"), ("...", "en"), ("a a a a a a", "fr"), ("the of " * 30_000, "de")]


@pytest.mark.parametrize("most", [1 << 21, 40, 0])
def test_collocations(spark, most):
    docs = some_texts()
    df = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in docs], "text string, lang string, phrase string, n int").repartition(5)
    for options in ({"least": 6}, {"least": 4, "longest": 3, "top": 7, "percent": 80}):
        got = collocations.collocations(df, most=most, share=50, **options).collect()
        assert sorted(map(tuple, got)) == mined(docs, **options)
    assert collocations.collocations(df.where("lang = 'xx'"), most=most).count() == 0


def test_another_seed_gives_the_same_counts(spark):
    df = spark.createDataFrame(some_texts(), "text string, lang string")
    tables = []
    for seeds in (range(1), range(1, 2)):
        vocabulary, seed = collocations.vocabulary_of(df, seeds)
        assert seed == seeds[0]
        levels = collocations.frequent_phrases(df, vocabulary, seed, 6, 4, 1 << 20, 50)
        tables.append((sorted(tuple(r) for r in vocabulary.select("lang", "word", "n").collect()), [sorted(r["a"] for r in x.collect()) for x in levels]))
    assert tables[0] == tables[1]


@given(st.lists(st.lists(st.integers(1, 12), min_size=3, max_size=3), min_size=1, max_size=60), st.lists(st.integers(0, 12), max_size=80))
@settings(max_examples=80, deadline=None)
def test_tries(phrases, stream):
    keys = string_hashes(__import__("pyarrow").array([str(i) for i in range(13)]))
    keys[0] = 0
    distinct = {tuple(p) for p in phrases}
    trie = collocations.build_trie(keys[np.array(sorted(distinct))])
    at, states = collocations.advance(trie, np.array(stream, np.int64), keys, 3)
    assert at.tolist() == [i for i in range(len(stream) - 2) if tuple(stream[i : i + 3]) in distinct and 0 not in stream[i : i + 3]]
    assert [tuple(r) for r in collocations.spelled(trie, states, 3)] == [tuple(keys[stream[i : i + 3]]) for i in at]
