"""Map the driver's parquet tables onto the labelled-utterance data model.

Every fixture returns DataFrames with the library's canonical columns:
``id`` (bigint), ``intent`` (string), optional ``v`` (array<double>) or
``text`` (string), and ``split`` in {train, val, test}.  The out-of-domain
marker is the intent value ``OOD_LABEL``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: fixture conventions
OOD_LABEL = "oos"
VECTOR_OOD_CLASSES = (8, 9)
TEXT_OOD_LANG = "es"
SHORT_TEXT_OOD_ROLE = "system"
UTTERANCE_SPLIT = r"[.\n]+"


class Splits(NamedTuple):
    train: DataFrame
    val: DataFrame
    test: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a text-heavy scan at least ``defaultParallelism`` tasks.

    Only when the scan has fewer partitions than cores (a small table, or one
    large row group that a single task would read): a round-robin
    repartition of the raw rows.  Large scans already have many partitions
    and are returned untouched, so no shuffle is added at scale."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def split_of(id_col: Column) -> Column:
    """3/1/1 train/val/test assignment on the row id (every row lands in one split)."""
    m = F.pmod(id_col, F.lit(5))
    return F.when(m < 3, "train").when(m == 3, "val").otherwise("test")


def _three(df: DataFrame, ood_in_train: bool) -> Splits:
    train = df.filter(F.col("split") == "train")
    if not ood_in_train:
        train = train.filter(F.col("intent") != OOD_LABEL)
    return Splits(train, df.filter(F.col("split") == "val"), df.filter(F.col("split") == "test"))


def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` -> (id, v array<double>, intent, split)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.when(F.col("label").isin(*VECTOR_OOD_CLASSES), F.lit(OOD_LABEL))
         .otherwise(F.col("label").cast("string")).alias("intent"),
        split_of(F.col("vec_id")).alias("split"))


def vector_splits(spark: SparkSession, sf_dir: str, ood_in_train: bool = False) -> Splits:
    return _three(vector_table(spark, sf_dir), ood_in_train)


def pair_id(key: str, pos: str):
    """One long for (key, pos): ``pos`` is an int, so no two pairs share one; a key of
    2^32 or more overflows, which is an error in ANSI mode, not a merged row."""
    return F.col(key).cast("long") * F.lit(1 << 31) + F.col(pos).cast("int")


def utterance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` exploded into trimmed, non-empty utterances.

    Key is (doc_id, pos); ``id`` is the single-column key of ``pair_id``."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    u = (d.select("doc_id", "lang", F.posexplode(F.split("text", UTTERANCE_SPLIT)).alias("pos", "raw"))
         .select("doc_id", "pos", F.trim("raw").alias("text"), F.col("lang").alias("intent"))
         .filter(F.length("text") > 0))
    return u.select(pair_id("doc_id", "pos").alias("id"), "doc_id", "pos", "text",
                    F.when(F.col("intent") == TEXT_OOD_LANG, F.lit(OOD_LABEL)).otherwise(F.col("intent")).alias("intent"),
                    split_of(F.col("doc_id")).alias("split"))


def utterance_splits(spark: SparkSession, sf_dir: str, ood_in_train: bool = False) -> Splits:
    return _three(utterance_table(spark, sf_dir), ood_in_train)


def short_text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` -> (id, text, intent=role, split by conversation)."""
    c = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return c.select(pair_id("conv_id", "turn").alias("id"), "text",
                    F.when(F.col("role") == SHORT_TEXT_OOD_ROLE, F.lit(OOD_LABEL)).otherwise(F.col("role")).alias("intent"),
                    split_of(F.col("conv_id")).alias("split"))


def cross_corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-domain ``documents`` plus the foreign ``benchmark`` corpus as OOD."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("intent"),
                                                     F.lit("documents").alias("corpus"))
    b = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(OOD_LABEL).alias("intent"),
                                                     F.lit("benchmark").alias("corpus"))
    return d.unionByName(b)


def cross_corpus_splits(spark: SparkSession, sf_dir: str) -> Splits:
    """Foreign-corpus OOD: whole ``documents`` are in-domain (split by doc_id),
    ``benchmark`` items are the OOD rows of validation (even item_id) and test
    (odd item_id); they never appear in training.  Ids are 2 * doc_id and
    2 * item_id + 1, so the two corpora share none."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    docs = d.select((2 * F.col("doc_id")).alias("id"), "text", F.col("lang").alias("intent"), split_of(F.col("doc_id")).alias("split"))
    b = read_table(spark, sf_dir, "benchmark")
    foreign = b.select((2 * F.col("item_id") + 1).alias("id"), "text", F.lit(OOD_LABEL).alias("intent"),
                       F.when(F.pmod("item_id", F.lit(2)) == 0, "val").otherwise("test").alias("split"))
    return _three(docs.unionByName(foreign), False)


def quality_splits(spark: SparkSession, sf_dir: str, label_col: str = "quality") -> Splits:
    """Documents with a ``labels`` row; OOD = label value 0 (e.g. low quality).
    Documents without a label row are left out (inner join on doc_id)."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lab = read_table(spark, sf_dir, "labels").select("doc_id", label_col)
    j = d.join(lab, "doc_id")
    rows = j.select(F.col("doc_id").alias("id"), "text",
                    F.when(F.col(label_col) == 0, F.lit(OOD_LABEL)).otherwise(F.lit("ok")).alias("intent"),
                    split_of(F.col("doc_id")).alias("split"))
    return _three(rows, False)
