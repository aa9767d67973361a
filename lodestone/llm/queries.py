"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chat_format import rotate_perspectives
from lodestone.llm.exact_dedup import exact_groups
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import RULES, ablation, ledger, passes
from lodestone.plans.staging import table


def tokenizer_file() -> str:
    """The vocabulary file that the queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import transcoded

    path = tokenizer_file()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()  # noqa: E731
        for batch in batches:
            made = [(len(ids), sha(",".join(map(str, ids.tolist()))), sha(text)) for ids, text in transcoded(path, batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*made)))} if made else {}, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import hash_bucket, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", hash_bucket("doc_id", 4) == 2)
    model = train(docs.where("not held_out"))
    said = docs.select("doc_id", "held_out", predict(spark, model, F.col("text")).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import hash_bucket
    from lodestone.llm.language_model import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = hash_bucket("doc_id", 5) == 1
    found = score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("v1")).alias("base_failed"), passes("v3").alias("kept"), F.col("failed").alias("failed_bits"),
    )


_OP5_BITS = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM p WHERE len(words) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i+4], ' ')) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT p.r, doc_id, len(words) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters,
             length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
             length(regexp_replace(t, '\P{Nd}+', '', 'g')) AS n_digits, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words, len(list_distinct(words)) AS n_distinct_words
      FROM p LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
             + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_letters >= 20 AND 2 * n_upper > n_letters)::BIGINT
             + 128 * (n_lines >= 10 AND 10 * n_bullet_lines > 9 * n_lines)::BIGINT + 256 * (n_lines >= 10 AND 10 * n_ellipsis_lines > 3 * n_lines)::BIGINT + 512 * (2 * n_digits > word_chars)::BIGINT
             + 1024 * (n_words >= 10 AND 10 * n_letter_words < 6 * n_words)::BIGINT + 2048 * (n_words >= 50 AND 10 * n_distinct_words < n_words)::BIGINT AS failed_bits FROM m)"""
OP5_SQL = _OP5_BITS + """ SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy fails, fails alone, and would let through if it were dropped, over all documents."""
    return ablation(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v3")


ABLATION_SQL = _OP5_BITS + " SELECT rule, bit, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only, count(*) FILTER (failed_bits & ~bit = 0) AS n_kept_without FROM b, (VALUES " + ", ".join(f"('{r}', {1 << k}::BIGINT)" for k, r in enumerate(RULES)) + ") v(rule, bit) GROUP BY rule, bit"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
x AS (SELECT m.*, s.perspective, '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS header
      FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM x),
e AS (SELECT *, sum(length(rendered)) OVER w AS char_end, row_number() OVER w - 1 AS position FROM r
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, header, rendered, (char_end - length(rendered))::BIGINT AS char_start, char_end::BIGINT AS char_end, role = perspective AS is_target,
       (char_end - length(rendered) + CASE WHEN role = perspective THEN length(header) ELSE 0 END)::BIGINT AS mask_start,
       (CASE WHEN role = perspective THEN char_end - 1 ELSE char_end - length(rendered) END)::BIGINT AS mask_end
FROM e
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import substring_dedup

    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i+12], ' ')) AS h FROM d, unnest(range(1, len(words) - 11)) AS u(i)),
f AS (SELECT h, min(doc_id) AS low FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, i + k AS place FROM w JOIN f USING (h), (SELECT unnest(range(13)) AS k) WHERE doc_id > low),
g AS (SELECT doc_id, list(place) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_select(words, list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(coalesce(gone, []), j))), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_id import hash_bucket
    from lodestone.llm.quality_classifier import score_quality

    held_out = hash_bucket("doc_id", 3) == 1
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.structure_repair import damaged, digests, repair

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    found = repair(damaged(given, F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20))
    every = given.select(F.struct(F.col("conv_id").alias("id")).alias("conv")).distinct()
    whole = every.join(found.conversations, "conv", "left").join(digests(found.messages), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("conv.id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, row_number() OVER () AS rid FROM conversations),
c AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS f FROM k),
r AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM c, range(CASE WHEN f = 3 THEN 2 ELSE 1 END) WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
s AS (SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
        NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut FROM o),
m AS (SELECT conv_id, i, role, text, c, blank, seen AND NOT blank AS dup, cut AND NOT seen AND NOT blank AS trunc,
        coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS bad, turn FROM s),
w AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
        count(*) FILTER (bad) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (3, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']),
        (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:']), (3, 3, 'II', 4, ['user:', 'assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:'])) v(s, t, e, p, l)),
q AS (SELECT conv_id, 0::BIGINT AS i, 0 AS st, {'cost': 0::BIGINT, 'audit': ''} AS best, []::VARCHAR[] AS lines FROM w
  UNION ALL
  SELECT conv_id, i, t2 AS st, min({'cost': cost, 'audit': audit}) AS best, arg_min(lines, {'cost': cost, 'audit': audit}) AS lines FROM (
    SELECT q.conv_id, m.i, e.t2, q.best.cost + ins.p + e.p2 AS cost, q.best.audit || ins.e || e.e2 AS audit, list_concat(list_concat(q.lines, ins.l), e.l2) AS lines
    FROM q JOIN m ON m.conv_id IS NOT DISTINCT FROM q.conv_id AND m.i = q.i + 1 JOIN ins ON ins.s = q.st,
    LATERAL (SELECT ins.t AS t2, 'D' AS e2, 3 AS p2, []::VARCHAR[] AS l2
      UNION ALL SELECT CASE m.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'K', m.trunc::INT, [m.role || ':' || m.text] WHERE NOT m.blank AND NOT m.dup AND (m.c = 's' AND ins.t = 0 OR m.c = 'u' AND ins.t <> 2 OR m.c = 'a' AND ins.t = 2)
      UNION ALL SELECT CASE ins.t WHEN 2 THEN 3 ELSE 2 END, 'R', 2 + m.trunc::INT, [CASE ins.t WHEN 2 THEN 'assistant:' ELSE 'user:' END || m.text] WHERE NOT m.blank AND NOT m.dup) e) GROUP BY conv_id, i, t2),
z AS (SELECT q.conv_id, min({'cost': q.best.cost + ins.p, 'audit': q.best.audit || ins.e}) AS best, arg_min(list_concat(q.lines, ins.l), {'cost': q.best.cost + ins.p, 'audit': q.best.audit || ins.e}) AS lines
  FROM q JOIN w ON w.conv_id IS NOT DISTINCT FROM q.conv_id AND q.i = w.n JOIN ins ON ins.s = q.st AND ins.t IN (0, 3) GROUP BY q.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(w.blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(z.best.cost, 0) AS cost, coalesce(z.best.audit, '') AS audit, sha256(coalesce(array_to_string(z.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT lang, k, array_to_string(words[i:i+k-1], ' ') AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k), unnest(range(1, len(words) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS words FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT f.lang, f.phrase, f.a, n, cut, x.a AS l, y.a AS r, ((1000::HUGEINT * f.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM f JOIN n USING (lang), unnest(range(1, f.k)) AS u(cut)
      JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.words[1:cut], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.words[cut+1:], ' ') WHERE f.k > 1),
b AS (SELECT lang, phrase, a, n, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'cut': cut}) AS w FROM c GROUP BY ALL),
s AS (SELECT lang, array_to_string(words[i:i+m-1], ' ') AS phrase, max(a) AS longer FROM f, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY w.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, w.l AS l, w.r AS r, n, w.score AS score
      FROM b LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase WHERE longer IS NULL OR longer < b.a)
SELECT * FROM o WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_exact_dedup": op1_exact_dedup, "op2_bpe": op2_bpe, "op3_language_id": op3_language_id, "op4_language_model": op4_language_model, "op5_quality_rules": op5_quality_rules, "op6_chat_format": op6_chat_format, "op7_substring_dedup": op7_substring_dedup, "op8_packing": op8_packing, "op9_quality_classifier": op9_quality_classifier, "op10_simhash": op10_simhash, "op11_structure_repair": op11_structure_repair, "op12_nearest": op12_nearest, "op13_collocations": op13_collocations, "rule_ablation": rule_ablation}


def llm_oracles() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_quality_rules": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op11_structure_repair": OP11_SQL, "op13_collocations": OP13_SQL, "rule_ablation": ABLATION_SQL}
