"""Format round trips over the driver tables: the utterance table is written
in a source layout (intent TSV, intent CSV) under the shared checkpoint
folder and read back with the library readers, so the readers run over
whole tables that Spark derives from the given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import fixtures as FX
from ..sources import readers as R


def intent_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = FX.utterance_table(spark, sf_dir)
    root = scratch_dir(spark, "tsv")
    ood = F.col("intent") == FX.OOD_LABEL
    rows = u.select(F.when(ood, F.lit(R.ROSTD_OOD)).otherwise(F.col("intent")).alias("c0"), F.lit("-").alias("c1"),
                    F.col("text").alias("c2"), F.when(ood, F.lit(R.ROSTD_FILLER)).otherwise(F.lit("-")).alias("c3"),
                    "split")
    files = {"OODRemovedtrain.tsv": (F.col("split") == "train") & ~ood, "OODrelease.tsv": (F.col("split") == "train") & ood,
             "eval.tsv": F.col("split") == "val", "test.tsv": F.col("split") == "test"}
    for name, cond in files.items():
        rows.filter(cond).drop("split").write.mode("overwrite").option("sep", "\t").option("escape", '"').csv(f"{root}/{name}")
    back = R.read_intent_tsv(spark, root)
    return back.groupBy("split", "intent").agg(F.count(F.lit(1)).alias("n"))


def intent_csv_roundtrip(spark: SparkSession, sf_dir: str, k: int = 75, version: int = 0) -> DataFrame:
    u = FX.utterance_table(spark, sf_dir)
    root = scratch_dir(spark, "csv")
    ood = F.col("intent") == FX.OOD_LABEL
    rows = u.select("text", F.when(ood, F.lit("none")).otherwise(F.col("intent")).alias("labels"),
                    ood.cast("int").alias("is_ood"), "split")
    out = None
    for split in ("train", "val", "test"):
        path = R.snips_path(root, split, k, version)
        rows.filter(F.col("split") == split).drop("split").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        part = R.read_intent_csv(spark, path, split)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("split", "intent").agg(F.count(F.lit(1)).alias("n"))


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark three detectors on the driver tables, store each result as a
    named run file, then summarise the folder (file-name parsing, fpr
    coalescing, sort)."""
    from ..operators import detectors as D
    from ..operators import text as TO
    from . import benchmark as B
    root = scratch_dir(spark, "results")
    vec = FX.vector_splits(spark, sf_dir)
    utt = FX.utterance_splits(spark, sf_dir)
    knn = B.benchmark(D.KNN(), vec)
    adb = B.benchmark_adb(vec)
    rake = B.benchmark_labels(TO.RakeDetector().fit(utt.train).predict(utt.test), utt.test)
    R.write_run_json(knn, root, R.run_name("embeddings", "KNN", "precomputed", False, False, "oos"))
    R.write_run_json(adb, root, R.run_name("embeddings", "ADB", "precomputed", False, False, "oos", (0.75, 0.01)))
    R.write_run_json(rake, root, R.run_name("documents", "RAKE", "None", False, False, "oos"))
    out = R.read_results(spark, root)
    return out.select(*[F.round(c, 6).alias(c) if c in R.RESULT_METRICS else F.col(c) for c in out.columns])
