"""Metrics vs brute-force numpy definitions, with ties and edge cases."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.operators import metrics as M


def _roc(scores, y):
    order = np.unique(scores)[::-1]
    tp = np.array([(y[scores >= s]).sum() for s in order], dtype=float)
    fp = np.array([(1 - y[scores >= s]).sum() for s in order], dtype=float)
    return order, np.r_[0, tp], np.r_[0, fp]


def brute(scores, y, level=0.95):
    _, tp, fp = _roc(scores, y)
    P, N = y.sum(), len(y) - y.sum()
    tpr, fpr = tp / P, fp / N
    auroc = np.trapezoid(tpr, fpr)
    prec = tp[1:] / (tp[1:] + fp[1:])
    ap = np.sum(np.diff(tp) / P * prec)
    i = np.argmax(tpr >= level)
    f = ((level - tpr[i - 1]) * fpr[i] + (tpr[i] - level) * fpr[i - 1]) / (tpr[i] - tpr[i - 1])
    return auroc, ap, f, fpr[i]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ranking_metrics_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(size=300), 1)  # many ties
    y = (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(scores, y)], "score double, y int")
    r = M.ranking_metrics(df).first()
    auroc, ap, f95, _ = brute(scores, y)
    assert r["auroc"] == pytest.approx(auroc, abs=1e-12)
    assert r["aupr"] == pytest.approx(ap, abs=1e-12)
    assert r["fpr_95"] == pytest.approx(f95, abs=1e-12)
    step = M.ranking_metrics(df, interpolate=False).first()
    assert step["fpr_95"] == pytest.approx(brute(scores, y)[3], abs=1e-12)


def test_auroc_symmetry_and_partition_invariance(spark):
    rng = np.random.default_rng(5)
    rows = [(float(s), int(t)) for s, t in zip(rng.normal(size=200), rng.random(200) < 0.4)]
    df = spark.createDataFrame(rows, "score double, y int")
    a = M.ranking_metrics(df).first()["auroc"]
    b = M.ranking_metrics(df.withColumn("score", -F.col("score"))).first()["auroc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)
    one = M.ranking_metrics(df.coalesce(1)).first()
    many = M.ranking_metrics(df.repartition(8)).first()
    assert one == many


def test_edge_perfect_inverted_equal(spark):
    perfect = spark.createDataFrame([(1.0, 1), (0.9, 1), (0.2, 0), (0.1, 0)], "score double, y int")
    assert M.ranking_metrics(perfect).first()["auroc"] == 1.0
    inv = perfect.withColumn("score", -F.col("score"))
    assert M.ranking_metrics(inv).first()["auroc"] == 0.0
    equal = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], "score double, y int")
    r = M.ranking_metrics(equal).first()
    assert r["auroc"] == 0.5 and r["aupr"] == 0.5


def test_threshold_curve_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=150)
    y = (rng.random(150) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    for lower in (False, True):
        curve = {r["i"]: r for r in M.threshold_curve(df, lower).collect()}
        ts = np.linspace(s.min() - 0.1, s.max() + 0.1, 100)
        for i, t in enumerate(ts):
            pred = s < t if lower else s > t
            tp = int((pred & (y == 1)).sum())
            fp = int((pred & (y == 0)).sum())
            assert curve[i]["tp"] == tp and curve[i]["fp"] == fp
            assert curve[i]["threshold"] == t


def test_mcc_f1_zero_division(spark):
    df = spark.createDataFrame([(True, False), (True, False)], "y boolean, pred boolean")
    r = M.label_metrics(df).first()
    assert r["f1"] == 0.0 and r["mcc"] == 0.0


def test_threshold_curve_scores_exactly_on_grid(spark):
    """Scores equal to grid thresholds exercise the strict / non-strict edges."""
    base = np.array([0.0, 1.0])
    ts = np.linspace(base.min() - 0.1, base.max() + 0.1, 100)
    s = np.concatenate([base, ts[1:-1:7], ts[3:60:11] + 1e-12, ts[5:90:13] - 1e-12])
    s = s[(s >= 0.0) & (s <= 1.0)]
    y = (np.arange(len(s)) % 3 == 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    for lower in (False, True):
        curve = {r["i"]: r for r in M.threshold_curve(df, lower).collect()}
        for i, t in enumerate(ts):
            pred = s < t if lower else s > t
            assert curve[i]["tp"] == int((pred & (y == 1)).sum())
            assert curve[i]["fp"] == int((pred & (y == 0)).sum())
