"""Evaluation operators: ROC prefix sums, FPR@TPR, average precision, AUROC,
confusion counts, F-beta, MCC and the 100-point threshold sweep.

All functions take a *scored* DataFrame with a numeric ``score`` column and a
binary ``y`` column (1/true = out-of-domain, the positive class) and run as
Spark aggregations; nothing row-level is collected.  Rows with a null score
are excluded (the library's missing-value contract).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayscope.session import ensure_checkpoint_dir

# fixed values: evaluation conventions
TPR_LEVELS = (0.95, 0.90)
SWEEP_POINTS = 100
SWEEP_MARGIN = 0.1
TUNE_BETAS = (0.5, 1.0, 1.5)


def validate_ood_labels(scored: DataFrame, score: str = "score", label: str = "y") -> None:
    """Raise unless labels are all 0/1 and the frame is non-empty (one aggregate pass)."""
    r = scored.agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(~F.col(label).cast("int").isin(0, 1) | F.col(label).isNull()).alias("bad")).first()
    if r["n"] == 0:
        raise ValueError("empty input to a metric")
    if r["bad"]:
        raise ValueError(f"{r['bad']} labels are not 0 or 1")


def _clean(scored: DataFrame, score: str, label: str) -> DataFrame:
    return (scored.select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"))
            .filter(F.col("score").isNotNull() & ~F.isnan("score")))


def materialised(ranged: DataFrame) -> DataFrame:
    """Write the range-partitioned frame once (checkpoint in the shared folder):
    the offsets and the rows must come from the same partitions, and two
    evaluations of a range exchange may sample different bounds."""
    ensure_checkpoint_dir(ranged.sparkSession)
    return ranged.checkpoint()


def descending_prefix_sums(df: DataFrame, order_col: str, value_cols: list[str],
                           n_parts: int | None = None) -> DataFrame:
    """Running sums of ``value_cols`` in descending ``order_col`` order without a
    single-partition window: range-partition on the key, per-partition totals
    (one row per partition) give each partition its offset, then a window
    runs inside each partition only."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(df.repartitionByRange(n_parts, F.col(order_col).desc()).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                      for c in value_cols])
    local = Window.partitionBy("_pid").orderBy(F.col(order_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_pid")  # one row per partition
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(local) + F.col(f"_o_{c}"))
    return out.drop("_pid", *[f"_o_{c}" for c in value_cols])


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      n_parts: int | None = None) -> DataFrame:
    """1-based row number in ``order`` over the whole frame, computed with range
    partitioning + per-partition offsets instead of a single-partition window."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(df.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid").orderBy(*order)
    out = ranged.join(F.broadcast(offsets), "_pid")  # one row per partition
    return out.withColumn(name, F.row_number().over(local) + F.col("_off")).drop("_pid", "_off")


def roc_points(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """One row per distinct score (descending): ``pos``/``neg`` in the tie group
    and cumulative ``tp``/``fp`` including the group (sklearn ROC points)."""
    s = _clean(scored, score, label)
    groups = s.groupBy("score").agg(F.sum("y").cast("long").alias("pos"),
                                    (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))
    cum = descending_prefix_sums(groups, "score", ["pos", "neg"])
    return cum.select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


def _totals(scored: DataFrame, score: str, label: str) -> tuple[int, int]:
    r = _clean(scored, score, label).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"),
                                         F.count(F.lit(1)).alias("n")).first()
    return int(r["p"]), int(r["n"]) - int(r["p"])


def _fpr_interp(level: float, P: int, N: int) -> Column:
    """First ROC point with tpr >= level, fpr linearly interpolated with the
    preceding point (the point before the first group is (0, 0))."""
    first = F.max(F.when(F.col("tp") / F.lit(P) >= F.lit(level),
                         F.struct("score", "tp", "fp", "pos", "neg")))
    return first


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "y",
                    levels: tuple[float, ...] = TPR_LEVELS, interpolate: bool = True) -> DataFrame:
    """One row: ``fpr_<NN>`` for each level, ``aupr`` (average precision) and
    ``auroc`` (trapezoid, ties count one half).  ``interpolate=False`` gives
    the step definition (fpr at the first point reaching the level)."""
    P, N = _totals(scored, score, label)
    roc = roc_points(scored, score, label)
    aggs = [(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.lit(P)).alias("aupr"),
            (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.lit(float(P) * float(N))).alias("auroc")]
    names = []
    for lv in levels:
        nm = f"_f{int(round(lv * 100))}"
        names.append((lv, nm))
        aggs.append(_fpr_interp(lv, P, N).alias(nm))
    row = roc.agg(*aggs)
    out = []
    for lv, nm in names:
        c = F.col(nm)
        tpr1, fpr1 = c.tp / F.lit(P), c.fp / F.lit(N)
        tpr0, fpr0 = (c.tp - c.pos) / F.lit(P), (c.fp - c.neg) / F.lit(N)
        if interpolate:
            val = ((F.lit(lv) - tpr0) * fpr1 + (tpr1 - F.lit(lv)) * fpr0) / (tpr1 - tpr0)
        else:
            val = F.when(F.lit(lv) <= 0, F.lit(0.0)).otherwise(fpr1)
        out.append(val.alias(f"fpr_{int(round(lv * 100))}"))
    return row.select(*out, "aupr", "auroc")


def swap_labels_scores(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Positive class becomes negative and the score order is reversed."""
    return scored.withColumn(score, -F.col(score)).withColumn(label, (1 - F.col(label).cast("int")))


def ood_metrics(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """fpr90/fpr95 (step definition) for OOD and for the swapped (in-domain)
    task, aupr both ways and auroc, in one row."""
    ood = ranking_metrics(scored, score, label, interpolate=False)
    ind = ranking_metrics(swap_labels_scores(scored, score, label), score, label, interpolate=False)
    a = ood.select(F.col("fpr_95").alias("ood_fpr95"), F.col("fpr_90").alias("ood_fpr90"),
                   F.col("aupr").alias("ood_aupr"), F.col("auroc").alias("auroc"))
    b = ind.select(F.col("fpr_95").alias("in_fpr95"), F.col("fpr_90").alias("in_fpr90"),
                   F.col("aupr").alias("in_aupr"))
    return _one_row_zip(a, b)


def _one_row_zip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side columns of two one-row frames without a join: union with
    null padding, then a null-ignoring aggregate (two rows)."""
    ca, cb = a.columns, b.columns
    fa = a.select(*ca, *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in cb])
    fb = b.select(*[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ca], *cb)
    return fa.unionByName(fb).agg(*[F.max(c).alias(c) for c in ca + cb])


# ---------------------------------------------------------------- confusion based

def confusion_counts(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    yc, pc = F.col(y).cast("boolean"), F.col(p).cast("boolean")
    return pred.agg(F.count_if(yc & pc).alias("tp"), F.count_if(~yc & pc).alias("fp"),
                    F.count_if(yc & ~pc).alias("fn"), F.count_if(~yc & ~pc).alias("tn"))


def fbeta_col(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    num = (1.0 + b2) * tp
    den = (1.0 + b2) * tp + b2 * fn + fp
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def mcc_col(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).otherwise(F.lit(0.0))


def precision_col(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def recall_col(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def label_metrics(pred: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """f1 + mcc of boolean predictions (label-only detectors)."""
    c = confusion_counts(pred, y, p)
    return c.select(fbeta_col(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("f1"),
                    mcc_col(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("mcc"))


def predict_threshold(scored: DataFrame, threshold: float, outdomain_is_lower: bool,
                      score: str = "score") -> DataFrame:
    """Strict comparison: OOD iff score < t (lower-is-OOD) else score > t."""
    s = F.col(score)
    return scored.withColumn("pred", (s < F.lit(threshold)) if outdomain_is_lower else (s > F.lit(threshold)))


def ood_accuracy(scored: DataFrame, threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """Accuracy of ``score >= threshold`` (non-strict) against the 0/1 label."""
    return scored.agg(F.avg(((F.col(score) >= F.lit(threshold)).cast("int") == F.col(label).cast("int"))
                            .cast("double")).alias("ood_accuracy"))


def linspace_thresholds(lo: float, hi: float, n: int = SWEEP_POINTS) -> np.ndarray:
    return np.linspace(lo, hi, n)


def threshold_curve(val_scored: DataFrame, outdomain_is_lower: bool, score: str = "score", label: str = "y",
                    n: int = SWEEP_POINTS, margin: float = SWEEP_MARGIN) -> DataFrame:
    """Precision, recall, F0.5, F1, F1.5 and MCC at ``n`` evenly spaced
    thresholds from min-margin to max+margin of the validation scores.

    One pass over the scores: each row's prediction pattern over the sorted
    thresholds is a prefix/suffix, so the row only needs the *count* of
    thresholds on one side of it; a ``groupBy`` of that count (<= n+1 groups,
    map-side combined) and running sums over n+1 rows give every confusion
    matrix."""
    spark = val_scored.sparkSession
    s = _clean(val_scored, score, label)
    mm = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = float(mm["lo"]) - margin, float(mm["hi"]) + margin
    ts = linspace_thresholds(lo, hi, n)
    arr = F.array(*[F.lit(float(t)) for t in ts])
    if outdomain_is_lower:
        # pred at i <=> score < t_i <=> i >= n - k, k = #{t_i > score} = n - #{t_i <= score}
        k = F.lit(n) - _count_thresholds_below(F.col("score"), arr, lo, hi, n, strict=False)
    else:
        # pred at i <=> score > t_i <=> i < k, k = #{t_i < score}
        k = _count_thresholds_below(F.col("score"), arr, lo, hi, n, strict=True)
    counts = s.groupBy(k.alias("k")).agg(F.sum("y").cast("long").alias("pos"),
                                         (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))
    grid = spark.range(0, n + 1).select(F.col("id").cast("int").alias("k"))
    full = grid.join(counts, "k", "left").fillna(0, ["pos", "neg"])
    P, N = F.sum("pos").over(Window.partitionBy()), F.sum("neg").over(Window.partitionBy())
    if outdomain_is_lower:
        pred_w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
        idx = F.lit(n) - F.col("k")            # suffix k' >= n - i
    else:
        pred_w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
        idx = F.col("k")                        # k' > i, read at row k = i
    cum = full.select("k", F.coalesce(F.sum("pos").over(pred_w), F.lit(0)).alias("tp"),
                      F.coalesce(F.sum("neg").over(pred_w), F.lit(0)).alias("fp"),
                      P.alias("P"), N.alias("N"))
    cum = cum.select(idx.alias("i"), "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
                     (F.col("N") - F.col("fp")).alias("tn")).filter((F.col("i") >= 0) & (F.col("i") < n))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return cum.select(
        "i", F.element_at(arr, F.col("i") + 1).alias("threshold"), "tp", "fp", "fn", "tn",
        precision_col(tp, fp).alias("precision"), recall_col(tp, fn).alias("recall"),
        fbeta_col(tp, fp, fn, 0.5).alias("f05"), fbeta_col(tp, fp, fn, 1.0).alias("f1"),
        fbeta_col(tp, fp, fn, 1.5).alias("f15"), mcc_col(tp, fp, fn, tn).alias("mcc"))


def _count_thresholds_below(s: Column, arr: Column, lo: float, hi: float, n: int, strict: bool) -> Column:
    """#{i : t_i < s} (strict) or #{i : t_i <= s} for the increasing linear grid
    ``arr``.  The grid index is estimated arithmetically, then the exact answer
    is settled by comparing against the 5 thresholds around the estimate (the
    estimate is off by at most one step), so each row costs a handful of
    code-generated comparisons instead of n."""
    step = (hi - lo) / (n - 1)
    j0 = F.least(F.greatest(F.floor((s - F.lit(lo)) / F.lit(step)), F.lit(0)), F.lit(n - 1)).cast("int")
    c = F.greatest(j0 - 2, F.lit(0))
    terms = []
    for o in range(5):
        t = F.element_at(arr, c + o + 1)
        below = (t < s) if strict else (t <= s)
        terms.append(F.when((c + o <= n - 1) & below, 1).otherwise(0))
    return c + sum(terms)


def tune_threshold(val_scored: DataFrame, outdomain_is_lower: bool, score: str = "score", label: str = "y",
                   n: int = SWEEP_POINTS) -> float:
    """Threshold with the first (lowest index) maximal MCC."""
    curve = threshold_curve(val_scored, outdomain_is_lower, score, label, n)
    best = curve.agg(F.min(F.struct((-F.col("mcc")).alias("m"), F.col("i"), F.col("threshold")))).first()[0]
    return float(best["threshold"])


def benchmark_scores(test_scored: DataFrame, val_scored: DataFrame, outdomain_is_lower: bool,
                     score: str = "score", label: str = "y") -> DataFrame:
    """Six-metric benchmark row: ranking metrics on direction-adjusted test
    scores (higher = more OOD), f1/mcc of the strict threshold rule tuned on
    the validation split."""
    adj = test_scored.withColumn("_adj", -F.col(score) if outdomain_is_lower else F.col(score))
    rank = ranking_metrics(adj, "_adj", label)
    t = tune_threshold(val_scored, outdomain_is_lower, score, label)
    lab = label_metrics(predict_threshold(test_scored, t, outdomain_is_lower, score)
                        .filter(F.col(score).isNotNull()), label, "pred")
    return _one_row_zip(rank, lab).select("fpr_95", "fpr_90", "aupr", "auroc", "f1", "mcc")


# ------------------------------------------------------- multi-class evaluation

def classification_metrics(pred: DataFrame, y: str = "intent", p: str = "pred") -> DataFrame:
    """accuracy, macro F1 and micro F1 of multi-class predictions."""
    per = per_class_counts(pred, y, p)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    agg = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                  F.avg(f1).alias("f1_macro"))
    n = pred.agg(F.count(F.lit(1)).alias("n"))
    return _one_row_zip(agg, n).select(
        (F.col("tp") / F.col("n")).alias("accuracy"), "f1_macro",
        fbeta_col(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("f1_micro"))


def per_class_counts(pred: DataFrame, y: str = "intent", p: str = "pred") -> DataFrame:
    """Per label (union of true and predicted labels): tp, fp, fn, support."""
    pairs = pred.groupBy(F.col(y).alias("t"), F.col(p).alias("q")).count()
    truth = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("count").alias("support"),
                                                        F.sum(F.when(F.col("t") == F.col("q"), F.col("count")).otherwise(0)).alias("tp"))
    predicted = pairs.groupBy(F.col("q").alias("label")).agg(F.sum("count").alias("npred"))
    j = truth.join(predicted, "label", "full").fillna(0, ["support", "tp", "npred"])
    return j.select("label", "tp", (F.col("npred") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "support")


def weighted_report(pred: DataFrame, y: str = "intent", p: str = "pred") -> DataFrame:
    """Support-weighted precision/recall/F1 (zero division -> 0) plus MCC."""
    per = per_class_counts(pred, y, p)
    prec = precision_col(F.col("tp"), F.col("fp"))
    rec = recall_col(F.col("tp"), F.col("fn"))
    f1 = fbeta_col(F.col("tp"), F.col("fp"), F.col("fn"), 1.0)
    rep = per.agg((F.sum(prec * F.col("support")) / F.sum("support")).alias("precision"),
                  (F.sum(rec * F.col("support")) / F.sum("support")).alias("recall"),
                  (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
                  F.sum("support").alias("support"))
    return _one_row_zip(rep, multiclass_mcc(pred, y, p))


def multiclass_mcc(pred: DataFrame, y: str = "intent", p: str = "pred") -> DataFrame:
    """Gorodkin's multi-class MCC from the confusion margins."""
    per = per_class_counts(pred, y, p)
    t_k = F.col("support").cast("double")
    p_k = (F.col("tp") + F.col("fp")).cast("double")
    agg = per.agg(F.sum("tp").cast("double").alias("c"), F.sum(t_k).alias("s"),
                  F.sum(t_k * p_k).alias("tp_sum"), F.sum(p_k * p_k).alias("pp"), F.sum(t_k * t_k).alias("tt"))
    num = F.col("c") * F.col("s") - F.col("tp_sum")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return agg.select(F.when(den > 0, num / den).otherwise(0.0).alias("mcc"))


def cv_mean_std(per_fold: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Mean and population standard deviation over folds."""
    aggs = []
    for c in metric_cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return per_fold.agg(*aggs)


def exact_percentile(df: DataFrame, value: str, p: float, group: str | None = None) -> DataFrame:
    """Exact percentile with linear interpolation (v[lo] + (v[hi] - v[lo]) * t,
    h = p * (n - 1)) per group, without collecting a group into one task:
    ranks come from range partitioning, then only the two order statistics
    around h are kept per group."""
    g = [F.col(group)] if group else []
    grp = [group] if group else []
    counts = df.groupBy(*grp).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        w = Window.orderBy(group)  # one row per group
        counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                        F.lit(0)))
        j = df.join(counts, group)
    else:
        j = _one_row_broadcast(df, counts.withColumn("_start", F.lit(0)))
    ranked = global_row_number(j, g + [F.col(value).asc()], "_rn").withColumn("_r", F.col("_rn") - 1 - F.col("_start"))
    h = F.lit(p) * (F.col("_n") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    picked = ranked.filter((F.col("_r") == lo) | (F.col("_r") == hi))
    agg = picked.groupBy(*grp).agg(F.min(F.when(F.col("_r") == lo, F.col(value))).alias("_a"),
                                   F.max(F.when(F.col("_r") == hi, F.col(value))).alias("_b"),
                                   F.first(h - lo).alias("_t"))
    return agg.select(*grp, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("pct"))


def _one_row_broadcast(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row (values collected:
    a single row of scalars)."""
    r = one.first()
    return df.select("*", *[F.lit(r[c]).alias(c) for c in one.columns])
