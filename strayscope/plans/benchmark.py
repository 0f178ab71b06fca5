"""Benchmark plans: fit a detector on train, score val/test once, tune the
threshold on val and report the reference's six metrics (or f1/mcc for
label-only detectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.detectors import ADB, Detector
from ..sources.fixtures import OOD_LABEL, Splits


def with_labels(scores: DataFrame, rows: DataFrame, ood_label: str = OOD_LABEL) -> DataFrame:
    """Attach y = (intent == ood_label) (and ``split`` when present) to (id, score) by key."""
    extra = ["split"] if "split" in rows.columns else []
    lab = rows.select("id", (F.col("intent") == F.lit(ood_label)).cast("int").alias("y"), *extra)
    return scores.join(lab, "id")


def score_split(det: Detector, rows: DataFrame, ood_label: str = OOD_LABEL) -> DataFrame:
    """Scores of one split with labels, checkpointed (scored once, reused by
    every metric; lineage cut so a lost executor does not rerun the scan)."""
    return with_labels(det.score(rows), rows, ood_label).checkpoint()


def benchmark(det: Detector, splits: Splits, ood_label: str = OOD_LABEL) -> DataFrame:
    """Fit on train; validation and test rows are scored in one pass (one
    broadcast of the fitted state, one checkpoint), then separated by split."""
    det.fit(splits.train)
    both = splits.val.withColumn("_part", F.lit("val")).unionByName(splits.test.withColumn("_part", F.lit("test")))
    lab = both.select("id", (F.col("intent") == F.lit(ood_label)).cast("int").alias("y"), "_part")
    scored = det.score(both).join(lab, "id").checkpoint()
    val = scored.filter(F.col("_part") == "val")
    test = scored.filter(F.col("_part") == "test")
    return M.benchmark_scores(test, val, det.outdomain_is_lower)


def benchmark_labels(pred: DataFrame, rows: DataFrame, ood_label: str = OOD_LABEL) -> DataFrame:
    """f1 + mcc of label predictions (ADB, RAKE): pred column holds a label or a bool."""
    lab = rows.select("id", (F.col("intent") == F.lit(ood_label)).alias("y"))
    return M.label_metrics(pred.join(lab, "id"), "y", "is_ood_pred")


def benchmark_adb(splits: Splits, ood_label: str = OOD_LABEL, alpha: float = 0.75, step: float = 0.01) -> DataFrame:
    adb = ADB(ood_label, alpha, step).fit(splits.train)
    pred = adb.predict(splits.test).select("id", (F.col("pred") == F.lit(ood_label)).alias("is_ood_pred"))
    return benchmark_labels(pred, splits.test, ood_label)


def round_cols(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
                       else F.col(f.name) for f in df.schema.fields])
