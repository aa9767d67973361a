"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for every text; the ledger keeps the measurements and one bit for each failed rule. Policies are
masks with a version: a text passes if none of the policy's bits is set, so a new policy or an ablation reads the ledger and
no text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: name -> failed, over the measurements below. A rule's bit is its place in this order; add new ones at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "capitals": "n_letters >= 20 and 2 * n_upper > n_letters",
    "bullets": "n_lines >= 10 and 10 * n_bullet_lines > 9 * n_lines",
    "ellipses": "n_lines >= 10 and 10 * n_ellipsis_lines > 3 * n_lines",
    "digits": "2 * n_digits > word_chars",
    "wordless": "n_words >= 10 and 10 * n_letter_words < 6 * n_words",
    "one_note": "n_words >= 50 and 10 * n_distinct_words < n_words",
}
BASE = ("few_words", "repeated_windows")
#: version -> names of the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": tuple(RULES)[:7], "v3": tuple(RULES)}


def bits(names: tuple[str, ...], rules: Mapping[str, str] = RULES) -> int:
    """The mask of these rules in a ledger made with ``rules``; a name that it lacks is an error."""
    return sum(1 << list(rules).index(n) for n in names)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_upper,
    n_digits, n_bullet_lines, n_ellipsis_lines, n_letter_words and n_distinct_words.

    Windows of five words are compared by a 64-bit hash within one text. A null text has no words; columns of ``docs`` that are
    named like a measurement are not kept unless listed in ``keep``, which may not list such a name.
    """
    held = F.struct(F.lit(0).alias("_"), *keep).alias("held")
    text = docs.select(held, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts = text.select(
        "held", "t",
        F.expr(f"filter(split(t, r'{SPACE}'), x -> x != '')").alias("words"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')").alias("lines"),
    )
    gram = "xxhash64(get(words, i), get(words, i + 1), get(words, i + 2), get(words, i + 3), get(words, i + 4))"
    grams = parts.select(
        "held", "t", F.size("words").alias("n"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_own_lines"),
        F.expr(r"size(filter(lines, x -> x rlike r'^[\x20\x09-\x0D]*[-*•]'))").alias("n_bullets"), F.expr(r"size(filter(lines, x -> x rlike r'(\.\.\.|…)[\x20\x09-\x0D]*$'))").alias("n_ellipses"),
        F.expr(r"size(filter(words, w -> w rlike r'\p{L}'))").alias("n_lettered"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.expr(f"if(size(words) >= 5, transform(sequence(0, size(words) - 5), i -> {gram}), array())").alias("grams"),
    )
    # Only texts with a repeated window are sorted.
    ordered = grams.withColumn("ordered", F.expr("if(size(array_distinct(grams)) < size(grams), sort_array(transform(grams, (h, i) -> struct(h, i))), array())"))
    hashes = ordered.withColumn("hs", F.expr("transform(ordered, x -> x.h)"))
    marked = hashes.withColumn("at", F.expr("""
        sort_array(filter(zip_with(zip_with(ordered, concat(array(cast(null as bigint)), hs), (x, p) -> struct(x.i as i, x.h as h, p as p)),
                                   slice(hs, 2, greatest(size(hs), 1)), (y, q) -> if(y.h = y.p or y.h = q, y.i, null)), x -> x is not null))"""))
    covered = "aggregate(zip_with(at, slice(at, 2, greatest(size(at), 1)), (a, b) -> coalesce(least(5, b - a), 5)), 0L, (s, x) -> s + x)"
    count = lambda e: F.expr(e).cast("long")
    return marked.select(
        *[F.col("held")[c].alias(c) for c in keep],
        count("n").alias("n_words"), count(r"length(translate(t, ' \t\n\u000B\u000C\r', ''))").alias("word_chars"),
        count(f"length(t) - length(translate(t, '{SYMBOLS}', ''))").alias("n_symbols"),
        count("n_lines").alias("n_lines"), count("n_lines - n_own_lines").alias("n_dup_lines"), count(covered).alias("n_repeat_words"),
        count(r"length(regexp_replace(t, r'\P{L}+', ''))").alias("n_letters"), count(r"length(regexp_replace(t, r'\P{Lu}+', ''))").alias("n_upper"),
        count(r"length(regexp_replace(t, r'\P{Nd}+', ''))").alias("n_digits"), count("n_bullets").alias("n_bullet_lines"), count("n_ellipses").alias("n_ellipsis_lines"), count("n_lettered").alias("n_letter_words"), count("n_distinct").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: Mapping[str, str] = RULES) -> DataFrame:
    """The measurements and ``failed``, a long with bit k set where the k-th rule failed."""
    failed = " | ".join(f"if({rule}, {1 << k}L, 0L)" for k, rule in enumerate(rules.values()))
    return measure(docs, text_col, keep).withColumn("failed", F.expr(failed or "0L"))


def passes(policy: str, failed: str = "failed", rules: Mapping[str, str] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> Column:
    """Whether a text passes the policy of this version, by the bits of a ledger made with ``rules``."""
    return F.col(failed).bitwiseAND(F.lit(bits(policies[policy], rules)).cast("long")) == 0


def ablation(ledger_rows: DataFrame, policy: str, rules: Mapping[str, str] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """One row for each rule of the policy: texts it fails, texts that only it fails (they'd come back without it), and texts
    kept without it; an empty ledger gives zeros. ``rules`` are those that the ledger was made with."""
    mask = bits(policies[policy], rules)
    each_rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(rules) if mask >> k & 1])).alias("r")
    masks = ledger_rows.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    none = ledger_rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("n"))
    each = masks.unionByName(none).select("f", "n", each_rule).select("f", "n", "r.*")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule", "bit").agg(
        some(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), some(F.col("f") == F.col("bit")).alias("n_only"),
        some(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
