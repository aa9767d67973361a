"""From the documents table to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language_id import UNKNOWN, predict, train
from lodestone.llm.near_copies import near_copies_dedup
from lodestone.llm.packing import pack
from lodestone.llm.queries import tokenizer_file
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.plans.staging import stage, table


#: A text whose n-grams are so much less likely (nats each) than those of its likeliest language's own texts isn't in that language.
LEAST_FIT = -2.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those that fit no learned language; ``lang`` becomes the language predicted.

    Learns from the stage's own rows with a language. Null and empty texts go; repeated rows are judged alike; without any row
    that has a language nothing is identified and all go. A column ``__told`` of the input would be lost.
    """
    model = train(docs)
    told = docs.withColumn("__told", predict(spark, model, F.col("text")))
    kept = told.where((F.col("__told.lang") != UNKNOWN) & (F.col("__told.fit") >= LEAST_FIT))
    return kept.select(*[F.col("__told.lang").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, and of rows that repeat both one stays. A column
    ``__exact_key`` of the input would be lost."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are linked whose five-word shingles have a Jaccard similarity of at least 0.8; of each component the row with the
    smallest doc_id stays. Fingerprints and their pivot tables find what lies within two bits, an exact search the rest. Texts
    without words are copies of each other; of rows that repeat doc_id and text one stays."""
    return near_copies_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also start in a document with a smaller doc_id. Texts without any are left as they are; one that
    is cut has its kept words joined by one space, and may be empty; n_chars follows the text. Null texts stay null. Rows that
    share a doc_id don't cut each other."""
    cut = substring_dedup(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*[{"text": text, "n_chars": size}.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece; a null or empty text is its end token alone."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("language_id", keep_languages), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats), ("packing", pack_sequences),
]

#: Naive Bayes, near-copy components and tokenization can't be told in SQL; tests/llm compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
