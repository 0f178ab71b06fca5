"""Edge cases: zero / null vectors, one class, single-row class, all-equal
scores, empty splits, partition-count invariance."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.operators import detectors as D
from strayscope.operators import metrics as M
from strayscope.operators import prep as P
from strayscope.operators.pairs import NearestOp, pair_scan
from strayscope.sources import fixtures as FX
from tests.conftest import SF01


def test_zero_and_null_vectors(spark):
    refs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(10, [0.0, 0.0]), (11, None), (12, [2.0, 0.0])], "id long, v array<double>")
    got = {r["qid"]: r["value"] for r in pair_scan(q, refs, NearestOp(1, "cosine_sim")).collect()}
    assert got == {10: 0.0, 12: 1.0}  # zero vector -> cosine 0; null vector -> no score


def test_duplicate_of_train_row_has_distance_zero(spark):
    sp = FX.vector_splits(spark, SF01)
    tr = sp.train.limit(5)
    got = [r["score"] for r in D.KNN().fit(sp.train).score(tr).collect()]
    assert all(abs(s) < 1e-7 for s in got)


def test_single_class_trust_score_is_null_and_adb_caps(spark):
    sp = FX.vector_splits(spark, SF01)
    one = sp.train.filter(F.col("intent") == "0")
    ts = D.TrustScore().fit(one).score(sp.test).collect()
    assert all(r["score"] is None for r in ts)  # no other class to compare with
    from strayscope.operators import vectors as V
    rad = V.adb_radius(one, V.class_centroids(one)).first()["radius"]
    assert rad == 2.0


def test_single_row_class_uses_first_neighbour(spark):
    refs = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [5.0, 5.0], "b")],
                                 "id long, v array<double>, intent string")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "id long, v array<double>")
    nn = pair_scan(q, refs, NearestOp(2, "l2", by_class=True), label_col="intent")
    got = {r["cls"]: r["d"] for r in nn.groupBy("cls").agg(F.max_by("value", "rank").alias("d")).collect()}
    assert got["a"] == pytest.approx(np.sqrt(2.0)) and got["b"] == pytest.approx(np.sqrt(41.0))


def test_all_equal_scores_threshold_and_metrics(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (1.0, 0)], "score double, y int")
    curve = M.threshold_curve(df, outdomain_is_lower=False).collect()
    assert len(curve) == 100
    assert M.ranking_metrics(df).first()["auroc"] == 0.5


def test_empty_split_gives_empty_scores(spark):
    sp = FX.vector_splits(spark, SF01)
    empty = sp.test.filter(F.lit(False))
    assert D.KNN().fit(sp.train).score(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_partition_count_invariance(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        e = FX.vector_table(spark, SF01).repartition(parts)
        folds = sorted((r["id"], r["fold"]) for r in P.stratified_folds(e).collect())
        roc = M.roc_points(spark.createDataFrame([(float(i % 7), i % 2) for i in range(50)], "score double, y int"))
        roc_rows = sorted(tuple(r) for r in roc.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    ref_folds = sorted((r["id"], r["fold"]) for r in P.stratified_folds(FX.vector_table(spark, SF01)).collect())
    assert folds == ref_folds
    assert roc_rows[0][3] >= 0 and len(roc_rows) == 7


def test_open_set_splits_of_25_classes(spark):
    from strayscope.operators.prep import open_set_splits
    sizes = [1 + (7 * k) % 11 for k in range(22)] + [600, 700, 5]
    rows = [(f"c{k:02d}",) for k, n in enumerate(sizes) for _ in range(n)]
    total = sum(sizes)
    ratio, tolerance = 0.5, 0.001
    got = open_set_splits(spark.createDataFrame(rows, "intent string"), ratio, tolerance=tolerance)
    sums = np.zeros(1, np.int64)
    for n in sizes:
        sums = np.concatenate([sums, sums + n])
    want = np.flatnonzero((sums >= (1 - tolerance) * ratio * total) & (sums <= (1 + tolerance) * ratio * total))
    found = got.selectExpr("count(*) AS n", "count(DISTINCT mask) AS d", "sum(mask) AS s", "sum(n_rows) AS r").first()
    assert (found.n, found.d, found.s, found.r) == (len(want), len(want), int(want.sum()), int(sums[want].sum()))


def test_long_texts_keep_their_tokens(spark):
    from strayscope.operators.text import keyword_hits
    words = " ".join(f"w{k % 50}x" for k in range(3000)).replace("0", "a").replace("1", "b")
    docs = spark.createDataFrame([(1, words + " needle stack"), (2, words), (3, None), (4, "")], "id long, text string")
    keys = spark.createDataFrame([("needle stack", 2), ("absent", 1)], "phrase string, n_words int")
    assert [r.id for r in keyword_hits(docs, keys).collect()] == [1]
