"""Class state that doesn't go to every task: same results as the small path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.operators import detectors as D
from strayscope.operators import pairs
from strayscope.operators import vectors as V
from strayscope.sources import fixtures as FX
from tests.conftest import SF001


@pytest.fixture()
def blocks(monkeypatch):
    def small():
        monkeypatch.setattr(V, "CLASS_STATE_BYTES", 0)
        monkeypatch.setattr(pairs, "DEFAULT_BLOCK_BYTES", 1500)  # two or three classes
    return small


def rows(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_nearest_centroid_and_boundaries(spark, blocks):
    sp = FX.vector_splits(spark, SF001)

    def results():
        centroids = V.class_centroids(sp.train)
        adb = D.ADB().fit(sp.train)
        near = V.nearest_centroid(sp.test, centroids).select("id", "pred_euclidean", "d_euclidean", "pred_cosine", "d_cosine", "pred_angular", "d_angular")
        return rows(near), rows(V.adb_radius(sp.train, centroids)), rows(adb.predict(sp.test).select("id", "pred", "dist"))

    want = results()
    blocks()
    assert results() == want


@pytest.mark.parametrize("name", ["class_euclidean", "class_maha", "class_maha_pca"])
def test_class_detectors(spark, blocks, name):
    sp = FX.vector_splits(spark, SF001)
    want = rows(D.get_detector(name).fit(sp.train).score(sp.test).select("id", "score"))
    blocks()
    got = rows(D.get_detector(name).fit(sp.train).score(sp.test).select("id", "score"))
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1] for r in got], [r[1] for r in want], rtol=1e-6)


def test_ties_of_many_equal_references():
    """Equal references never become candidate rows of all pairs at once."""
    n = 20_000
    refs = pairs.RefBlock(np.arange(n)[::-1].copy(), np.ones((n, 8)), np.array(["c"] * n, dtype=object))
    seen = []
    op = pairs.NearestOp(3, "l2")
    exact = op._exact
    op._exact = lambda q, r, qi, ri: seen.append(len(qi)) or exact(q, r, qi, ri)
    got = op.combine(op.partial(np.arange(40), np.zeros((40, 8)), {}, refs))
    assert max(seen) <= pairs.TIED_PAIRS and got["ref_id"].tolist() == [0, 1, 2] * 40 and np.allclose(got["value"], np.sqrt(8))


def test_levels_of_sums_follow_the_tasks(spark):
    df = FX.vector_table(spark, SF001).select("id", "v")
    few = V.covariance(df.coalesce(1))[1]
    assert np.allclose(few, V.covariance(df.repartition(70))[1], atol=1e-12)
    plan = V._gram_partials(df.coalesce(1), "v", None, None)
    assert plan.rdd.getNumPartitions() == 1
    assert V.square_distances(np.ones((2, 3)), np.ones((1, 3))).tolist() == [[0.0], [0.0]]
    assert df.filter(F.col("v").isNull()).count() == 0
