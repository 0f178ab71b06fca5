"""Readers and writers for the labelled-utterance formats and result files.

Every reader returns one DataFrame (id, text, intent, split[, ...]) with the
OOD marker normalised to ``OOD_LABEL``; filters on ``split`` prune at scan
time.  Schemas are declared, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .fixtures import OOD_LABEL

# fixed values: raw OOD markers of the source formats
ROSTD_OOD = "outOfDomain"
ROSTD_FILLER = "FILLER"
RESULT_METRICS = ("fpr_95", "fpr_90", "fpr95", "fpr90", "aupr", "auroc", "f1", "mcc")


SPLIT_CODES = {"train": 0, "val": 1, "test": 2}
FOREIGN_CODE = 8
RECORD_BITS = 40  # of an id: the number of the record in its file, below the file's code
BROADCAST_BLOCKS = 1 << 17  # one row of 40 bytes per scanned block


def positioned(scan: DataFrame, code: int = 0) -> DataFrame:
    """Adds ``id`` = code * 2^40 + number of the record in the file (parts of a folder in
    the order of their names).

    ``scan`` comes straight from ``spark.read``.  Rows are numbered within their task as
    they are read; one small table of (file, block) -> records before it turns that into
    the place in the file, which depends neither on how the file is cut into tasks nor
    on the run, and tells repeated rows apart."""
    raw = scan.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_seen"))
    blocks = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_first"))
    blocks = written(blocks, "file-blocks")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    if blocks.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    place = F.lit(code << RECORD_BITS) + F.col("_seen") + F.col("_base")
    return raw.join(starts, ["_file", "_block"]).select(place.alias("id"), *scan.columns)


def _pairs(df: DataFrame, key: str, split: str, code: int) -> DataFrame:
    return (df.select(F.posexplode(key).alias("pos", "p"))
            .select((F.lit(code).cast("long") * F.lit(1 << 31) + F.col("pos")).alias("id"),
                    F.col("p")[0].alias("text"), F.col("p")[1].alias("intent"), F.lit(split).alias("split")))


def read_intent_json(spark: SparkSession, path: str, include_ood_in_train: bool = False) -> DataFrame:
    """One JSON object with arrays train/val/test/oos_train/oos_val/oos_test of
    [text, intent] pairs; in-domain and OOD parts concatenated per split."""
    pair = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([T.StructField(k, pair) for k in
                           ("train", "val", "test", "oos_train", "oos_val", "oos_test")])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = [_pairs(raw, "train", "train", 0), _pairs(raw, "val", "val", 1), _pairs(raw, "test", "test", 2),
             _pairs(raw, "oos_val", "val", 4), _pairs(raw, "oos_test", "test", 5)]
    if include_ood_in_train:
        parts.append(_pairs(raw, "oos_train", "train", 3))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TSV_SCHEMA = T.StructType([T.StructField("c0", T.StringType()), T.StructField("c1", T.StringType()),
                           T.StructField("c2", T.StringType()), T.StructField("c3", T.StringType())])


def _tsv(spark: SparkSession, path: str, code: int = 0) -> DataFrame:
    return positioned(spark.read.schema(TSV_SCHEMA).option("sep", "\t").option("header", False).option("escape", '"').csv(path), code)


def _tsv_intent() -> Column:
    return F.when(F.col("c0") == ROSTD_OOD, F.lit(OOD_LABEL)).otherwise(F.col("c0"))


def read_intent_tsv(spark: SparkSession, root: str, include_ood_in_train: bool = False) -> DataFrame:
    """Header-less TSV (intent, _, text, marker); ``outOfDomain`` -> OOD label.
    train = OODRemovedtrain.tsv (+ OODrelease.tsv), val = eval.tsv, test = test.tsv."""
    files = [("train", "OODRemovedtrain.tsv"), ("val", "eval.tsv"), ("test", "test.tsv")]
    if include_ood_in_train:
        files.append(("train", "OODrelease.tsv"))
    out = None
    for code, (split, name) in enumerate(files):
        df = _tsv(spark, f"{root}/{name}", code).select("id", F.col("c2").alias("text"), _tsv_intent().alias("intent"), F.lit(split).alias("split"))
        out = df if out is None else out.unionByName(df)
    return out


def read_rostd_flagged(spark: SparkSession, path: str, use_coarse_labels: bool = False, split: str = "train") -> DataFrame:
    """Same TSV, OOD flag from the 4th column == FILLER (null: not); optional coarse label
    (part before the first '/')."""
    df = _tsv(spark, path, SPLIT_CODES[split])
    label = F.substring_index(_tsv_intent(), "/", 1) if use_coarse_labels else _tsv_intent()
    return df.select("id", F.col("c2").alias("text"), label.alias("intent"),
                     F.coalesce((F.col("c3") == ROSTD_FILLER).cast("int"), F.lit(0)).alias("ood"), F.lit(split).alias("split"))


CSV_SCHEMA = "text string, labels string, is_ood int"


def read_intent_csv(spark: SparkSession, path: str, split: str, include_ood_in_train: bool = False) -> DataFrame:
    """Header CSV (text, labels, is_ood): is_ood = 1 -> OOD label; in train the
    OOD rows are relabelled when allowed, else dropped."""
    df = positioned(spark.read.schema(CSV_SCHEMA).option("header", True).option("escape", '"').csv(path), SPLIT_CODES[split])
    if split == "train" and not include_ood_in_train:
        df = df.filter(F.col("is_ood") == 0)
    return df.select("id", "text", F.when(F.col("is_ood") == 1, F.lit(OOD_LABEL)).otherwise(F.col("labels")).alias("intent"),
                     F.lit(split).alias("split"))


def read_plain_csv(spark: SparkSession, path: str, split: str, include_ood_in_train: bool = False) -> DataFrame:
    """Header CSV (text, intent) with the OOD label already in place."""
    df = positioned(spark.read.schema("text string, intent string").option("header", True).option("escape", '"').csv(path), SPLIT_CODES[split])
    if split == "train" and not include_ood_in_train:
        df = df.filter(F.col("intent") != OOD_LABEL)
    return df.withColumn("split", F.lit(split))


def snips_path(root: str, subset: str, k: int = 75, version: int = 0) -> str:
    return f"{root}/snips_{subset}_{k}_{version}.csv"


def read_sentiment_with_foreign(spark: SparkSession, sentiment_tsv: str, foreign: str | None = None,
                                foreign_kind: str = "single", split: str = "train") -> DataFrame:
    """Sentiment TSV (text, label 1 -> positive else negative) plus an optional
    foreign corpus as OOD; pair corpora join sentence1 and sentence2.  Foreign rows are
    numbered as a file of their own."""
    def rows(reader: DataFrame, code: int) -> DataFrame:
        return positioned(reader, code).withColumn("split", F.lit(split))

    tsv = spark.read.option("sep", "\t").option("escape", '"')
    code = SPLIT_CODES[split]
    s = rows(tsv.schema("text string, label int").csv(sentiment_tsv), code)
    s = s.select("id", "text", F.when(F.col("label") == 1, "positive").otherwise("negative").alias("intent"), "split")
    if foreign is None:
        return s
    if foreign_kind == "pair":
        names = spark.read.option("sep", "\t").option("header", True).csv(foreign).columns  # the header line only
        pairs = tsv.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(foreign)
        f = rows(pairs, FOREIGN_CODE + code).select("id", "split", F.concat_ws(" ", "sentence1", "sentence2").alias("text"))
    else:
        f = rows(spark.read.text(foreign), FOREIGN_CODE + code).select("id", "split", F.col("value").alias("text"))
    return s.unionByName(f.select("id", "text", F.lit(OOD_LABEL).alias("intent"), "split"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated text vectors 'word v1 ... vd' -> (word, vec array<double>)."""
    parts = F.split(F.col("value"), " ")
    return (spark.read.text(path)
            .select(parts[0].alias("word"),
                    F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec")))


def read_results(spark: SparkSession, results_dir: str) -> DataFrame:
    """Benchmark result files -> one row per run.

    Run parameters come from the file name
    ``dataset_detector_extractor_ckpt_oodtrain_label[_alpha_step].json``;
    '-best-ckpt' style suffixes are stripped from the extractor; fpr95/fpr90
    keys (when present) take precedence over fpr_95/fpr_90."""
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in RESULT_METRICS])
    raw = spark.read.schema(schema).json(f"{results_dir}/*.json")
    # a run is a file NAME.json, or a Spark-written folder NAME.json/part-*.json
    raw = raw.withColumn("_f", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json(/part-[^/]*)?$", 1))
    p = F.split("_f", "_")
    many = F.size(p) > 6
    out = raw.select(
        p[0].alias("dataset"), p[1].alias("detector"),
        F.split(p[2], "-")[0].alias("feature_extractor"),
        p[3].alias("use_best_ckpt"), p[4].alias("is_ood_label_in_train"), p[5].alias("ood_label"),
        F.when(many, p[6]).alias("adb_alpha"), F.when(many, p[7]).alias("adb_step_size"),
        F.coalesce("fpr95", "fpr_95").alias("fpr_95"), F.coalesce("fpr90", "fpr_90").alias("fpr_90"),
        "aupr", "auroc", "f1", "mcc")
    return out.orderBy("dataset", "detector", "feature_extractor", "use_best_ckpt", "is_ood_label_in_train")


def write_results_csv(df: DataFrame, out_dir: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(out_dir)


def write_run_results(df: DataFrame, out_dir: str) -> None:
    """Benchmark rows partitioned by run parameters (one JSON file per run)."""
    df.write.mode("overwrite").partitionBy("dataset", "detector").json(out_dir)


def run_name(dataset: str, detector: str, extractor: str, best_ckpt: bool, ood_in_train: bool, ood_label: str,
             adb: tuple[float, float] | None = None) -> str:
    """dataset_detector_extractor_ckpt_oodtrain_label[_alpha_step] (underscores in
    the extractor become dashes)."""
    name = f"{dataset}_{detector}_{extractor.replace('_', '-')}_{best_ckpt}_{ood_in_train}_{ood_label}"
    return name + (f"_{adb[0]}_{adb[1]}" if adb else "")


def write_run_json(metrics_row: DataFrame, results_dir: str, name: str) -> None:
    """One benchmark result (a one-row frame of metric columns) as NAME.json."""
    metrics_row.coalesce(1).write.mode("overwrite").json(f"{results_dir}/{name}.json")


def write_splits(df: DataFrame, root: str, k: int) -> None:
    """Open-set split tables (text, labels, is_ood): one file ``snips_{subset}_{k}_{version}.csv``
    for each subset and version in ``df`` (text, labels, is_ood, split, version)."""
    for r in df.select("split", "version").distinct().collect():  # three subsets of a few versions
        mine = df.filter((F.col("split") == r["split"]) & (F.col("version") == r["version"]))
        mine.select("text", "labels", "is_ood").write.option("header", True).option("escape", '"').csv(snips_path(root, r["split"], k, r["version"]))
