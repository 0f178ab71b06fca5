"""Benchmarks of heads fitted by shared-scan gradient descent (rows only: an iterative fit
isn't SQL; ``tests/test_gradient.py`` holds them against numpy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gradient as G
from ..sources import fixtures as FX
from . import benchmark as B
from .catalog import register

SETTINGS = [{"loss": loss, "l2": l2} for loss in ("softmax", "sigmoid") for l2 in (1e-4, 1e-3, 1e-2, 1e-1)]


@register("bench_doc_trained")
def bench_doc_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent sigmoid heads of all classes, fitted together."""
    return B.round_cols(B.benchmark(G.TrainedDOC(), FX.vector_splits(spark, sf_dir)))


@register("bench_doc_trained_with_ood")
def bench_doc_trained_with_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the OOD class among the training classes: its probability is the score."""
    splits = FX.vector_splits(spark, sf_dir, ood_in_train=True)
    return B.round_cols(B.benchmark(G.TrainedDOC(ood_in_train=True), splits))


@register("bench_msp_best_checkpoint")
def bench_msp_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax head at the epoch of the lowest validation loss."""
    splits = FX.vector_splits(spark, sf_dir)
    return B.round_cols(B.benchmark(G.TrainedHead(val=splits.val), splits))


@register("bench_svc_rbf_msp")
def bench_svc_rbf_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rbf support vector machine on random Fourier features, calibrated on held-out folds."""
    return B.round_cols(B.benchmark(G.KernelSVC(), FX.vector_splits(spark, sf_dir)))


@register("hpo_shared_scans")
def hpo_shared_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive halving over losses and penalties by held-out MCC, one scan a step for all."""
    found = G.search(FX.vector_splits(spark, sf_dir).train, SETTINGS)
    rows = [(s["loss"], s["l2"], s["epochs"], s["mcc"]) for s in found]
    return B.round_cols(spark.createDataFrame(rows, "loss string, l2 double, epochs int, mcc double").orderBy(F.col("epochs").desc(), F.col("mcc").desc(), "loss", "l2"))
