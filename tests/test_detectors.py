"""Detector invariants and brute-force checks on the embeddings fixture."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.operators import detectors as D
from strayscope.operators import vectors as V
from strayscope.sources import fixtures as FX
from tests.conftest import SF01


@pytest.fixture(scope="module")
def splits(spark):
    return FX.vector_splits(spark, SF01)


def _np(df):
    rows = df.orderBy("id").collect()
    return np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows]), [r["intent"] for r in rows]


def test_maha_trace_identity(splits):
    det = D.Mahalanobis().fit(splits.train)
    s = np.array([r["score"] for r in det.score(splits.train).collect()])
    ids, x, _ = _np(splits.train)
    rank = np.linalg.matrix_rank(np.cov(x.T))
    assert (s ** 2).sum() == pytest.approx(rank * (len(x) - 1), rel=1e-8)


def test_marginal_maha_identity(splits):
    det = D.MarginalMahalanobis().fit(splits.train)
    s = np.array([r["score"] for r in det.score(splits.train).collect()])
    _, x, _ = _np(splits.train)
    assert s.sum() == pytest.approx(len(x) * x.shape[1], rel=1e-8)


def test_lof_brute_force(splits):
    det = D.LOF().fit(splits.train)
    got = {r["id"]: r["score"] for r in det.score(splits.test).collect()}
    tid, tx, _ = _np(splits.train)
    qid, qx, _ = _np(splits.test)

    def cosd(a, b):
        an, bn = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        return np.clip(1 - an @ bn.T, 0, 2)

    k = 10
    dt = cosd(tx, tx)
    np.fill_diagonal(dt, np.inf)
    nn = np.argsort(dt, axis=1, kind="stable")[:, :k]
    kd = dt[np.arange(len(tx))[:, None], nn][:, -1]
    lrd = 1 / (np.maximum(kd[nn], dt[np.arange(len(tx))[:, None], nn]).mean(1) + 1e-10)
    dq = cosd(qx, tx)
    qn = np.argsort(dq, axis=1, kind="stable")[:, :k]
    reach = np.maximum(kd[qn], dq[np.arange(len(qx))[:, None], qn]).mean(1)
    want = 1.5 - lrd[qn].mean(1) * (reach + 1e-10)
    assert np.allclose([got[i] for i in qid], want, atol=1e-9)


def test_adb_closed_form_matches_grid_walk(spark, splits):
    cent = V.class_centroids(splits.train)
    rad = {r["intent"]: r["radius"] for r in V.adb_radius(splits.train, cent).collect()}
    keys, cmat = V.collect_matrix(cent, "intent")
    _, x, lab = _np(splits.train)
    xn = x / np.sqrt(np.maximum((x * x).sum(1, keepdims=True), 1e-12))
    lab = np.array(lab)
    for ci, c in enumerate(keys):
        d = np.linalg.norm(xn - cmat[ci], axis=1)
        ood, idm = (lab != c).astype(float), (lab == c).astype(float)
        per = ood.sum() / idm.sum()
        r = 0.0
        while r < 2:
            crit = ((d - r) * ood).mean() - ((r - d) * idm).mean() * per / 0.75
            if crit < 0:
                r -= 0.01
                break
            r += 0.01
        assert rad[c] == pytest.approx(r, abs=0.0100001)


def test_detector_refuses_ood_in_train(spark):
    sp = FX.vector_splits(spark, SF01, ood_in_train=True)
    with pytest.raises(ValueError):
        D.KNN().fit(sp.train)


def test_pca_full_rank_equals_centering(splits):
    a = {r["id"]: r["score"] for r in D.PCACosine().fit(splits.train).score(splits.test).collect()}
    mu = V.mean_vector(splits.train)
    _, tx, _ = _np(splits.train)
    qid, qx, _ = _np(splits.test)
    tc, qc = tx - mu, qx - mu
    cos = (qc @ tc.T) / np.linalg.norm(qc, axis=1)[:, None] / np.linalg.norm(tc, axis=1)[None, :]
    assert np.allclose([a[i] for i in qid], cos.max(1), atol=1e-9)
