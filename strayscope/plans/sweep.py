"""Benchmark sweep: detector x OOD-in-training grid on a fixture.

The grid is small and fixed (configurations, not data), so the driver loops
over it; each configuration is a full Spark job chain (fit -> score once ->
tune -> metrics) that returns one row.  Detectors that refuse OOD rows in
training, or need them, skip that configuration with a logged reason (the
reference writes no result file then); any other error ends the sweep.  Rows can be written with the run-results sink.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detectors as D
from ..operators import metrics as M
from ..operators import registry as REG
from ..sources import fixtures as FX
from ..sources.readers import write_run_results
from . import benchmark as B

# fixed values: detectors of the published grid (vector-input ones)
GRID_DETECTORS = ("trust_score", "entropy", "lof", "binary_msp", "msp", "doc", "adb", "knn", "cosine_nn",
                  "euclidean_nn", "maha", "cosine_entropy", "pca_entropy", "pca_cosine", "pca_euclidean")
METRICS = ("fpr_95", "fpr_90", "aupr", "auroc", "f1", "mcc")

SCHEMA = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("detector", T.StringType()),
                       T.StructField("feature_extractor", T.StringType()),
                       T.StructField("is_ood_label_in_train", T.BooleanType())]
                      + [T.StructField(m, T.DoubleType()) for m in METRICS])


def _make(name: str, ood_in_train: bool):
    if name in ("msp", "doc"):
        return D.get_detector(name, ood_in_train=ood_in_train)
    return D.get_detector(name)


def run_sweep(spark: SparkSession, sf_dir: str, detectors=GRID_DETECTORS, ood_options=(False, True),
              dataset: str = "embeddings", out_dir: str | None = None) -> DataFrame:
    rows = []
    for ood_in_train in ood_options:
        splits = FX.vector_splits(spark, sf_dir, ood_in_train=ood_in_train)
        for name in detectors:
            try:
                if name == "adb":
                    res = B.benchmark_adb(splits).first().asDict()
                else:
                    res = B.benchmark(_make(name, ood_in_train), splits).first().asDict()
            except D.NotApplicable as reason:
                logging.getLogger(__name__).warning("skipped %s, ood_in_train=%s: %s", name, ood_in_train, reason)
                continue
            rows.append((dataset, name, "precomputed", ood_in_train, *[res.get(m) for m in METRICS]))
    out = B.round_cols(spark.createDataFrame(rows, SCHEMA))  # one row per configuration
    if out_dir:
        write_run_results(out, out_dir)
    return out


# fixed values: text detectors of the published grid, and the columns of their result files
TEXT_DETECTORS = ("rake", "likelihood_ratio", "text_cosine_nn", "text_knn")
TEXT_COLUMNS = ("fpr95", "fpr90", *METRICS)


def run_text_sweep(splits_of, detectors=TEXT_DETECTORS, ood_options=(False, True), dataset: str = "conversations") -> DataFrame:
    """One row per text detector and OOD-in-training option that applies: labels give f1 and mcc, the
    likelihood ratio its step metrics, the others all six.  ``splits_of(ood_in_train)`` gives
    the splits."""
    out = None
    for ood_in_train in ood_options:
        splits = splits_of(ood_in_train)
        for name in detectors:
            kind = REG.entry(name)
            try:
                if kind.returns == "label":
                    found = B.benchmark_labels(kind.make().fit(splits.train).predict(splits.test), splits.test)
                elif name == "likelihood_ratio":
                    scored = B.with_labels(kind.make().fit(splits.train).score(splits.test), splits.test).checkpoint()
                    found = M.ranking_metrics(scored, interpolate=False).select(F.col("fpr_95").alias("fpr95"), F.col("fpr_90").alias("fpr90"), "aupr", "auroc")
                else:
                    found = B.benchmark(kind.make(), splits)
            except D.NotApplicable as reason:
                logging.getLogger(__name__).warning("skipped %s, ood_in_train=%s: %s", name, ood_in_train, reason)
                continue
            row = [F.col(c).cast("double").alias(c) if c in found.columns else F.lit(None).cast("double").alias(c) for c in TEXT_COLUMNS]
            part = found.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("detector"), F.lit(ood_in_train).alias("is_ood_label_in_train"), *row)
            out = part if out is None else out.unionByName(part)
    return B.round_cols(out)
