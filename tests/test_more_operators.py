"""Trust filters, naive Bayes, bootstrap head, word vectors, score registry, sweep."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.functions import scores as S
from strayscope.operators import detectors as D
from strayscope.operators import metrics as M
from strayscope.operators import text as TO
from strayscope.operators import trust as TR
from strayscope.sources import fixtures as FX
from tests.conftest import SF01


@pytest.fixture(scope="module")
def train(spark):
    return FX.vector_splits(spark, SF01).train


def _np(df):
    rows = df.orderBy("id").collect()
    return np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows]), np.array([r["intent"] for r in rows])


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=101)
    grp = np.array(["a", "b"] * 50 + ["a"])
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)], "g string, x double")
    got = {r["g"]: r["pct"] for r in M.exact_percentile(df, "x", 0.9, "g").collect()}
    for g in ("a", "b"):
        assert got[g] == pytest.approx(np.percentile(vals[grp == g], 90), abs=1e-12)
    assert M.exact_percentile(df, "x", 0.25).first()["pct"] == pytest.approx(np.percentile(vals, 25), abs=1e-12)


def test_density_filter_brute_force(train):
    kept = {r["id"] for r in TR.density_filter(train, 0.1).select("id").collect()}
    ids, x, lab = _np(train)
    want = set()
    for c in np.unique(lab):
        m = lab == c
        d = np.sqrt(((x[m][:, None, :] - x[m][None, :, :]) ** 2).sum(-1))
        rad = np.sort(d, axis=1)[:, min(10, m.sum()) - 1]
        eps = np.percentile(rad, 90)
        want |= set(ids[m][rad <= eps].tolist())
    assert kept == want


def test_gaussian_nb_matches_numpy(spark, train):
    nb = D.GaussianNB().fit(train)
    ids, x, lab = _np(train)
    classes = sorted(set(lab))
    theta = np.array([x[lab == c].mean(0) for c in classes])
    var = np.array([x[lab == c].var(0) for c in classes]) + 1e-9 * x.var(0).max()
    prior = np.array([(lab == c).mean() for c in classes])
    jll = np.log(prior) - 0.5 * np.log(2 * np.pi * var).sum(1) - 0.5 * (((x[:, None] - theta[None]) ** 2) / var[None]).sum(-1)
    got = {r["id"]: r["pred"] for r in nb.predict(train).collect()}
    assert [got[i] for i in ids] == [classes[j] for j in jll.argmax(1)]


def test_bootstrap_head_probabilities(spark, train):
    det = D.BootstrapHead().fit(train)
    assert det.cents.shape[0] == 15
    s = [r["score"] for r in det.score(train).collect()]
    assert all(0 < v <= 1 for v in s)


def test_word_vectors_deterministic_and_normal(spark):
    vocab = spark.createDataFrame([(f"w{i}", 5 + i) for i in range(400)], "word string, idx int")
    a = {r["idx"]: r["vec"] for r in TO.word_vector_table(vocab, dim=8).collect()}
    b = {r["idx"]: r["vec"] for r in TO.word_vector_table(vocab, dim=8).collect()}
    assert a == b and a[0] == [0.0] * 8
    allv = np.array([a[i] for i in range(5, 405)]).ravel()
    assert abs(allv.mean()) < 0.05 and allv.std() == pytest.approx(0.3836, rel=0.1)


def test_mean_pool(spark):
    enc = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 6)], "id long, pos int, token_id int")
    wv = spark.createDataFrame([(5, [1.0, 0.0]), (6, [3.0, 2.0])], "idx int, vec array<double>")
    got = {r["id"]: r["v"] for r in TO.mean_pool(enc, wv).collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 2.0]}


def test_score_registry_duplicates():
    with pytest.raises(ValueError):
        S.register_score("mahalanobis")(D.ClassMahalanobis)
    assert isinstance(S.get_score("euclidean"), D.ClassEuclidean)


def test_sweep_skips_inapplicable(spark):
    from strayscope.plans.sweep import run_sweep
    rows = run_sweep(spark, SF01, detectors=("knn", "binary_msp"), ood_options=(False, True)).collect()
    got = {(r["detector"], r["is_ood_label_in_train"]) for r in rows}
    assert got == {("knn", False), ("binary_msp", True)}


def test_encoder_udf_and_label_validation(spark):
    from strayscope.functions.encoders import hashing_encoder_column
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "hello")], "id long, text string")
    rows = {r["id"]: r["e"] for r in df.select("id", hashing_encoder_column(F.col("text"), 16).alias("e")).collect()}
    assert len(rows[1]) == 16 and sum(abs(x) for x in rows[2]) == 0
    assert abs(sum(x * x for x in rows[3]) - 1.0) < 1e-5
    bad = spark.createDataFrame([(0.1, 2)], "score double, y int")
    with pytest.raises(ValueError):
        M.validate_ood_labels(bad)
