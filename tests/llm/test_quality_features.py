"""Features of the quality classifier, counted one by one, and its sample."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_classifier as Q


def counted(text):
    """The features by plain loops over characters and words."""
    words = re.findall(r"\S+", text or "")
    if not words:
        return [0.0] * len(Q.FEATURES)
    n, chars = len(words), [c for w in words for c in w]
    share = lambda hits, of: hits / of if of else 0.0
    lines = [x for x in text.split("\n") if re.search(r"\S", x)]
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = {w: sum(x == w for x in words) for w in set(words)}
    return [
        math.log(n + 1), len(chars) / n, sum(c in "#*$%&|<>" for c in chars) / len(chars), share(sum(c.isupper() for c in chars), max(1, sum(c.isalpha() for c in chars))),
        sum(c.isdigit() for c in chars) / len(chars), sum(c in ".,;:!?" for c in chars) / n, 1 - len(set(grams)) / len(grams) if grams else 0.0, len(count) / n**0.8,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(len(w) <= 3 for w in words) / n, max(len(w) for w in words), max(count.values()) / n, sum(w[0].isupper() for w in words) / n,
    ]


def test_features(spark):
    rng = random.Random(3)
    pieces = ["The", "word", "été", "ÄB", "x1", "**", "a.b,c", "...", "\n", "\n\n", "\t", "same line\n", "12", "|", "long" * 50]
    texts = [None, "", " \n ", "one", "A\nA\nA"] + [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(60)] + ["many words " * 20_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", Q.measured(F.col("text")).alias("f")).collect()
    for r in got:
        assert r["f"] == pytest.approx(counted(texts[r["id"]]), abs=1e-9), texts[r["id"]]
