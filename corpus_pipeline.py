"""Training-data pipeline over ``documents`` (part of the llm subpackage).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayscope.llm import bpe_prefix, crf_language, fuzzy_lines, ngram_join, phrase_index
from strayscope.llm.common import prepare, quoted, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: the field is fitted on a bounded sample
    of the labelled ones; texts without letters go, and those whose words' likeliest
    languages have a mean probability under 0.35."""
    prepare(spark)
    return crf_language.keep_identified(docs, crf_language.train_on(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut (the first of each group stays), ``n_chars`` follows,
    and documents that had lines and have none left go."""
    prepare(spark)
    clean = fuzzy_lines.dedup_lines(docs)
    left = clean.filter((F.col("lines_removed") == 0) | F.col("text").rlike("[^ \t\n\\x0B\f\r]"))
    length = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*[length.alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies stays."""
    prepare(spark)
    return ngram_join.keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole
    shorter item) go."""
    prepare(spark)
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    prepare(spark)
    coded = bpe_prefix.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None  # a trained model and MinHash bands aren't SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
