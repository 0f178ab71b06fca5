"""Novelty detectors: ``fit(train)`` builds state, ``score(df)`` returns (id, score).

Input frames carry ``id`` (bigint), ``v`` (array<double>) and ``intent``.
``outdomain_is_lower`` tells which side of the score is out-of-domain.
All-pairs work goes through :func:`pairs.pair_scan`; state that is d x d or
classes x d (checked sizes) is kept as numpy and applied per Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import OOD_LABEL
from ..session import written
from . import vectors as V
from .classes import class_residual_moments, numbered_classes, residuals_of_many, within_radius_of_many
from .pairs import AdjustedEntropyOp, NearestOp, QuadraticMinOp, SoftmaxStatsOp, pair_scan

# fixed values: detector constants
ENTROPY_EPS = 1e-6
TRUST_MIN_DIST = 1e-12
LOF_NEIGHBORS = 10
LOF_OFFSET = 1.5
LOF_LRD_EPS = 1e-10
HEAD_TEMPERATURE = 10.0
MC_PASSES = 15
MC_DROP_RATE = 0.35
HASH_PRIME = 2147483647
HASH_A, HASH_B, HASH_C = 48271, 69621, 40692
HASH_A2, HASH_C2 = 1583458089, 12345


class NotApplicable(ValueError):
    """The configuration doesn't fit the training data (it needs or refuses OOD rows)."""


class Detector:
    name = "base"
    outdomain_is_lower = False
    forbids_ood_in_train = True

    def __init__(self, ood_label: str = OOD_LABEL):
        self.ood_label = ood_label

    def check_train(self, train: DataFrame) -> None:
        missing = {"id", "intent"} - set(train.columns)
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
        if self.forbids_ood_in_train and train.filter(F.col("intent") == self.ood_label).limit(1).count() > 0:
            raise NotApplicable(f"found {self.ood_label!r} in training data; {self.name} needs in-domain rows only")

    def fit(self, train: DataFrame) -> "Detector":
        self.check_train(train)
        self._fit(train)
        return self

    def _fit(self, train: DataFrame) -> None:
        self.train = train.select("id", "v", "intent")

    def score(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def lite(self) -> "Detector":
        """Shallow copy without DataFrame attributes, safe to ship to tasks."""
        import copy
        c = copy.copy(self)
        for k, val in list(vars(c).items()):
            if isinstance(val, DataFrame):
                setattr(c, k, None)
        return c


def _scored(df: DataFrame) -> DataFrame:
    return df.select(F.col("qid").alias("id"), F.col("value").alias("score"))


class KNN(Detector):
    """Minimum Euclidean distance to any training row."""
    name = "knn"

    def score(self, df):
        return _scored(pair_scan(df, self.train, NearestOp(1, "l2")))


class EuclideanNN(KNN):
    name = "euclidean_nn"


class CosineNN(Detector):
    """Largest cosine similarity to any training row (zero vectors -> 0)."""
    name = "cosine_nn"
    outdomain_is_lower = True

    def score(self, df):
        return _scored(pair_scan(df, self.train, NearestOp(1, "cosine_sim")))


def nn_label_lookup(df: DataFrame, train: DataFrame) -> DataFrame:
    """Intent of the most cosine-similar training row (first id on ties)."""
    r = pair_scan(df, train, NearestOp(1, "cosine_sim"), label_col="intent")
    return r.select(F.col("qid").alias("id"), F.col("ref_label").alias("pred"), F.col("value").alias("sim"))


class CosineEntropy(Detector):
    """Entropy of the adjusted soft-max over cosine similarities to all training rows."""
    name = "cosine_entropy"
    transform = None

    def score(self, df):
        p1 = SoftmaxStatsOp()
        p1.transform = self.transform
        stats = pair_scan(df, self.train, p1).checkpoint()  # read twice below
        q = df.select("id", "v").join(stats.withColumnRenamed("qid", "id"), "id")
        p2 = AdjustedEntropyOp()
        p2.transform = self.transform
        terms = pair_scan(q, self.train, p2)
        top = stats.select(F.col("qid"), "top_sim")
        ent = -(F.col("top_sim") * F.log(F.col("top_sim") + ENTROPY_EPS) + F.col("plogp"))
        return terms.join(top, "qid").select(F.col("qid").alias("id"), ent.alias("score"))


class _PCAMixin:
    def _fit_pca(self, train):
        mu, basis, _ = V.pca_basis(train)
        self.transform = (mu, basis)


class PCACosine(CosineNN, _PCAMixin):
    name = "pca_cosine"

    def _fit(self, train):
        super()._fit(train)
        self._fit_pca(self.train)

    def score(self, df):
        op = NearestOp(1, "cosine_sim")
        op.transform = self.transform
        return _scored(pair_scan(df, self.train, op))


class PCAEuclidean(KNN, _PCAMixin):
    name = "pca_euclidean"

    def _fit(self, train):
        super()._fit(train)
        self._fit_pca(self.train)

    def score(self, df):
        op = NearestOp(1, "l2")
        op.transform = self.transform
        return _scored(pair_scan(df, self.train, op))


class PCAEntropy(CosineEntropy, _PCAMixin):
    name = "pca_entropy"

    def _fit(self, train):
        super()._fit(train)
        self._fit_pca(self.train)


class Mahalanobis(Detector):
    """sqrt((x-mu)^T pinv(Sigma) (x-mu)), one global mean, Sigma with ddof 1."""
    name = "maha"

    def _fit(self, train):
        super()._fit(train)
        self.mean, cov, _ = V.covariance(self.train, ddof=1)
        self.prec = np.linalg.pinv(cov)

    def score(self, df):
        return V.quadratic_scores(df, self.mean, self.prec, sqrt=True)


class MarginalMahalanobis(Detector):
    """Squared global Mahalanobis distance, Sigma = sum rr^T / n, plain inverse."""
    name = "marginal_maha"
    forbids_ood_in_train = False

    def _fit(self, train):
        super()._fit(train)
        self.mean, cov, _ = V.covariance(self.train, ddof=0)
        self.prec = np.linalg.inv(cov)

    def score(self, df):
        return V.quadratic_scores(df, self.mean, self.prec, sqrt=False)


class MarginalMahalanobisPCA(Detector):
    """Sum over components j >= start of comp_j^2 / var_j (PCA of centred rows)."""
    name = "marginal_maha_pca"
    forbids_ood_in_train = False

    def __init__(self, ood_label: str = OOD_LABEL, start_elem: int = 0):
        super().__init__(ood_label)
        self.start_elem = start_elem

    def _fit(self, train):
        super()._fit(train)
        self.mean, self.basis, self.var = V.pca_basis(self.train)

    def score(self, df):
        b, var, mu, s = self.basis[:, self.start_elem:], self.var[self.start_elem:], self.mean, self.start_elem

        def fn(ids, x, _):
            comp = (x - mu[None, :]) @ b
            return pd.DataFrame({"id": ids, "score": (comp * comp / var[None, :]).sum(axis=1)})

        return V.score_rows(df, fn, "id long, score double")


class ClassEuclidean(Detector):
    """Minimum squared L2 distance to a class mean."""
    name = "class_euclidean"
    forbids_ood_in_train = False

    def _fit(self, train):
        super()._fit(train)
        means = V.long_to_vectors(V.class_vector_means(self.train), "intent")
        self.means = numbered_classes(means)
        self.weight = None

    def score(self, df):
        r = pair_scan(df, self.means, QuadraticMinOp(self.weight), label_col="intent")
        return r.select(F.col("qid").alias("id"), F.col("value").alias("score"))


class ClassMahalanobis(ClassEuclidean):
    """min over classes of squared Mahalanobis, pooled class-centred Sigma / n."""
    name = "class_maha"

    def _fit(self, train):
        super()._fit(train)
        _, cov, _ = class_residual_moments(self.train, ddof=0)
        self.weight = np.linalg.inv(cov)


class ClassMahalanobisPCA(Detector):
    """Nearest class mean by Euclidean distance, then the PCA-whitened norm of the
    residual over components j >= start (PCA of class-centred rows)."""
    name = "class_maha_pca"
    forbids_ood_in_train = False

    def __init__(self, ood_label: str = OOD_LABEL, start_elem: int = 0):
        super().__init__(ood_label)
        self.start_elem = start_elem

    def _fit(self, train):
        super()._fit(train)
        # PCA of the class-centred rows re-centres by their own (numerically ~0) mean
        resid_mean, cov, n = class_residual_moments(self.train, ddof=1)
        cov = cov - np.outer(resid_mean, resid_mean) * n / (n - 1)
        self.means = written(V.class_vector_means(self.train), "class-means")
        self.fits = V.class_state_fits(self.means, "intent")
        if self.fits:
            self.keys, self.cmat = V.collect_matrix(self.means, "intent")
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1]
        self.var, self.basis, self.resid_mean = w[order], v[:, order], resid_mean

    def score(self, df):
        b, var, rm = self.basis[:, self.start_elem:], self.var[self.start_elem:], self.resid_mean
        cmat = self.cmat if self.fits else np.zeros((1, b.shape[0]))
        if not self.fits:  # the rows less their nearest class mean
            df = residuals_of_many(df, self.means)

        def fn(ids, x, _):
            r = x - cmat[np.argmin(V.square_distances(x, cmat), axis=1)] - rm[None, :]
            comp = r @ b
            return pd.DataFrame({"id": ids, "score": (comp * comp / var[None, :]).sum(axis=1)})

        return V.score_rows(df, fn, "id long, score double")


class LOF(Detector):
    """Local outlier factor, novelty mode, cosine distance, k = 10:
    score = 1.5 - LOF(x) (lower = more outlying)."""
    name = "lof"
    outdomain_is_lower = True

    def __init__(self, ood_label: str = OOD_LABEL, k: int = LOF_NEIGHBORS):
        super().__init__(ood_label)
        self.k = k

    def _fit(self, train):
        super()._fit(train)
        nn = pair_scan(self.train, self.train, NearestOp(self.k, "cosine_dist", exclude_self=True))
        kdist = nn.groupBy(F.col("qid").alias("ref_id")).agg(F.max("value").alias("kdist"))
        reach = (nn.join(kdist, "ref_id")
                 .groupBy("qid").agg(F.avg(F.greatest("kdist", "value")).alias("mreach")))
        lrd = reach.select(F.col("qid").alias("ref_id"), (1.0 / (F.col("mreach") + LOF_LRD_EPS)).alias("lrd"))
        self.state = kdist.join(lrd, "ref_id").checkpoint()

    def score(self, df):
        nn = pair_scan(df, self.train, NearestOp(self.k, "cosine_dist"))
        j = nn.join(self.state, "ref_id")
        agg = j.groupBy("qid").agg(F.avg(F.greatest("kdist", "value")).alias("mreach"), F.avg("lrd").alias("mlrd"))
        lrd_x = 1.0 / (F.col("mreach") + LOF_LRD_EPS)
        return agg.select(F.col("qid").alias("id"), (F.lit(LOF_OFFSET) - F.col("mlrd") / lrd_x).alias("score"))


class CentroidHead:
    """Deterministic classifier head: softmax(T * cos(x, class centroid)).

    Classes are ordered lexically; state is classes x d (size-checked)."""

    def __init__(self, temperature: float = HEAD_TEMPERATURE, label: str = "intent"):
        self.temperature, self.label = temperature, label

    def fit(self, train: DataFrame) -> "CentroidHead":
        self.keys, self.cmat = V.collect_matrix(V.class_centroids(train, self.label), self.label)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        nrm = np.sqrt(np.einsum("ij,ij->i", x, x))
        xn = np.divide(x, nrm[:, None], out=np.zeros_like(x), where=nrm[:, None] > 0)
        return self.temperature * (xn @ self.cmat.T)

    def probs(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, pred, prob) - argmax class, first class on ties."""
        keys = np.array(self.keys, dtype=object)

        def fn(ids, x, _):
            p = self.probs(x)
            b = np.argmax(p, axis=1)
            return pd.DataFrame({"id": ids, "pred": keys[b], "prob": p[np.arange(len(b)), b]})

        return V.score_rows(df, fn, "id long, pred string, prob double")

    def prob_table(self, df: DataFrame) -> DataFrame:
        """Long form (id, cls, prob)."""
        keys = np.array(self.keys, dtype=object)

        def fn(ids, x, _):
            p = self.probs(x)
            return pd.DataFrame({"id": np.repeat(ids, len(keys)), "cls": np.tile(keys, len(ids)), "prob": p.ravel()})

        return V.score_rows(df, fn, "id long, cls string, prob double")


class TrustScore(Detector):
    """d(closest class other than the predicted one) / (d(predicted) + 1e-12);
    a class's distance is to its 2nd nearest training row (1st if it has one row).
    ``filtering`` = none | density | uncertainty prunes the training rows
    (alpha = percentile cut) before the per-class distances."""
    name = "trust_score"
    outdomain_is_lower = True

    def __init__(self, ood_label: str = OOD_LABEL, filtering: str = "none", alpha: float = 0.0):
        super().__init__(ood_label)
        self.filtering, self.alpha = filtering, alpha

    def _fit(self, train):
        super()._fit(train)
        self.head = CentroidHead().fit(self.train)
        if self.filtering != "none":
            from . import trust
            flt = {"density": trust.density_filter, "uncertainty": trust.uncertainty_filter}[self.filtering]
            self.train = flt(self.train, self.alpha).checkpoint()

    def score(self, df):
        nn = pair_scan(df, self.train, NearestOp(2, "l2", by_class=True), label_col="intent")
        per_class = nn.groupBy("qid", "cls").agg(F.max_by("value", "rank").alias("d"))
        pred = self.head.predict(df).select(F.col("id").alias("qid"), "pred")
        j = per_class.join(pred, "qid")
        agg = j.groupBy("qid").agg(F.min(F.when(F.col("cls") == F.col("pred"), F.col("d"))).alias("d_pred"),
                                   F.min(F.when(F.col("cls") != F.col("pred"), F.col("d"))).alias("d_other"))
        return agg.select(F.col("qid").alias("id"),
                          (F.col("d_other") / (F.col("d_pred") + TRUST_MIN_DIST)).alias("score"))


class _HeadDetector(Detector):
    forbids_ood_in_train = False

    def __init__(self, ood_label: str = OOD_LABEL, temperature: float = HEAD_TEMPERATURE):
        super().__init__(ood_label)
        self.temperature = temperature

    def _fit(self, train):
        super()._fit(train)
        self.head = CentroidHead(self.temperature).fit(self.train)

    def _from_probs(self, p: np.ndarray, head: "CentroidHead", x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score(self, df):
        head, me = self.head, self.lite()

        def fn(ids, x, _):
            return pd.DataFrame({"id": ids, "score": me._from_probs(head.probs(x), head, x)})

        return V.score_rows(df, fn, "id long, score double")


def entropy_of(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(p + ENTROPY_EPS)).sum(axis=1)


class Entropy(_HeadDetector):
    """-sum p ln(p + 1e-6) of the head probabilities."""
    name = "entropy"
    forbids_ood_in_train = True

    def _from_probs(self, p, head, x):
        return entropy_of(p)


class MSP(_HeadDetector):
    """Largest class probability; with the OOD class in training, its probability."""
    name = "msp"

    def __init__(self, ood_label: str = OOD_LABEL, temperature: float = HEAD_TEMPERATURE,
                 ood_in_train: bool = False):
        super().__init__(ood_label, temperature)
        self.ood_in_train = ood_in_train
        self.outdomain_is_lower = not ood_in_train

    def _from_probs(self, p, head, x):
        if self.ood_in_train:
            return p[:, head.keys.index(self.ood_label)]
        return p.max(axis=1)


class DOC(MSP):
    """One-vs-rest sigmoid heads sigmoid(logit_c); max (or the OOD class's)."""
    name = "doc"

    def _from_probs(self, p, head, x):
        s = 1.0 / (1.0 + np.exp(-head.logits(x)))
        if self.ood_in_train:
            return s[:, head.keys.index(self.ood_label)]
        return s.max(axis=1)


class BinaryMSP(_HeadDetector):
    """P(out-of-domain) of a two-class head trained on intent == ood_label."""
    name = "binary_msp"

    def _fit(self, train):
        self.train = train.select("id", "v", (F.col("intent") == self.ood_label).cast("string").alias("intent"))
        if self.train.filter(F.col("intent") == "true").limit(1).count() == 0:
            raise NotApplicable("binary_msp needs out-of-domain rows in the training data")
        self.head = CentroidHead(self.temperature).fit(self.train)

    def _from_probs(self, p, head, x):
        return p[:, head.keys.index("true")]


class MCDropout(MSP):
    """Mean head probabilities over 15 passes with a deterministic dropout mask
    (keep dim j of row i in pass r iff hash(i, r, j) >= rate, kept values
    scaled by 1/(1-rate)), then MSP."""
    name = "mc_dropout"

    def __init__(self, ood_label: str = OOD_LABEL, temperature: float = HEAD_TEMPERATURE,
                 ood_in_train: bool = False, passes: int = MC_PASSES, rate: float = MC_DROP_RATE):
        super().__init__(ood_label, temperature, ood_in_train)
        self.passes, self.rate = passes, rate

    def score(self, df):
        head, passes, rate, keep_ood = self.head, self.passes, self.rate, self.ood_in_train
        ood_idx = head.keys.index(self.ood_label) if keep_ood else None

        def fn(ids, x, _):
            acc = np.zeros((len(ids), len(head.keys)))
            d = x.shape[1]
            for r in range(passes):
                u = _uniform_hash(ids, r, d)
                mask = (u >= rate) * (1.0 / (1.0 - rate))
                acc += head.probs(x * mask)
            p = acc / passes
            return pd.DataFrame({"id": ids, "score": p[:, ood_idx] if keep_ood else p.max(axis=1)})

        return V.score_rows(df, fn, "id long, score double")


def hash_uniform_col(id_col, r_col, j: int = 0):
    """Column version of :func:`_uniform_hash` (same integers, JVM-side)."""
    p = F.lit(HASH_PRIME)
    h0 = F.pmod(id_col.cast("long"), p)
    h1 = F.pmod(h0 * HASH_A + r_col.cast("long") * HASH_B + F.lit(j * HASH_C), p)
    h2 = F.pmod(h1 * HASH_A2 + F.lit(HASH_C2), p)
    return h2.cast("double") / F.lit(float(HASH_PRIME))


def poisson1_cdf(kmax: int = 10) -> list[float]:
    import math
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


class BootstrapHead(_HeadDetector):
    """Bayesian-model-averaging stand-in for a variational network: 15
    Poisson(1)-bootstrap replicates of the centroid head (replicate weights
    from a deterministic hash of (row, replicate)), probabilities averaged,
    then MSP (or the OOD class's probability when trained with it)."""
    name = "bnn_bootstrap"

    def __init__(self, ood_label: str = OOD_LABEL, temperature: float = HEAD_TEMPERATURE,
                 replicates: int = MC_PASSES, ood_in_train: bool = False):
        super().__init__(ood_label, temperature)
        self.replicates, self.ood_in_train = replicates, ood_in_train
        self.outdomain_is_lower = not ood_in_train

    def _fit(self, train):
        Detector._fit(self, train)
        cdf = np.array(poisson1_cdf())
        reps = self.replicates

        def part(it):
            # per partition: for every (replicate, class) the weighted sum of the
            # L2-normalised rows and the weight total (Poisson(1) weights from
            # the (row id, replicate) hash) -> replicates x classes x d rows
            acc: dict = {}
            for pdf in it:
                pdf = pdf[pdf["v"].notna()]
                if len(pdf) == 0:
                    continue
                ids = pdf["id"].to_numpy(dtype=np.int64)
                x = np.vstack([np.asarray(a, dtype=np.float64) for a in pdf["v"].values])
                x = x / np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x), 1e-12))[:, None]
                labs = pdf["intent"].to_numpy(dtype=object)
                for r in range(reps):
                    u = _uniform_hash(ids, r, 1)[:, 0]
                    w = (u[:, None] >= cdf[None, :]).sum(axis=1).astype(np.float64)
                    for c in pd.unique(labs):
                        m = labs == c
                        sw, tw = acc.get((r, c), (0.0, 0.0))
                        acc[(r, c)] = (sw + (w[m, None] * x[m]).sum(axis=0), tw + w[m].sum())
            if acc:
                rows = [(r, c, j, float(v), float(tw)) for (r, c), (sw, tw) in acc.items() for j, v in enumerate(sw)]
                yield pd.DataFrame(rows, columns=["r", "intent", "pos", "s", "w"])

        parts = self.train.select(F.col("id").cast("long").alias("id"), "v", F.col("intent").cast("string")) \
            .mapInPandas(part, "r int, intent string, pos int, s double, w double")
        sums = parts.groupBy("r", "intent", "pos").agg((F.sum("s") / F.sum("w")).alias("m")).filter(F.col("m").isNotNull())
        nrm = sums.groupBy("r", "intent").agg(F.sqrt(F.greatest(F.sum(F.col("m") * F.col("m")), F.lit(1e-12))).alias("nr"))
        cent = sums.join(nrm, ["r", "intent"]).select(F.concat_ws("#", F.col("r").cast("string"), "intent").alias("k"),
                                                      "pos", (F.col("m") / F.col("nr")).alias("value"))
        keys, mat = V.collect_matrix(cent, "k")
        classes = sorted({k.split("#", 1)[1] for k in keys})
        d = mat.shape[1]
        self.cents = np.zeros((self.replicates, len(classes), d))
        for k, row in zip(keys, mat):
            r, c = k.split("#", 1)
            self.cents[int(r), classes.index(c)] = row
        self.head = CentroidHead(self.temperature)
        self.head.keys, self.head.cmat = classes, self.cents[0]

    def score(self, df):
        cents, tau, keys = self.cents, self.temperature, self.head.keys
        ood_idx = keys.index(self.ood_label) if self.ood_in_train else None

        def fn(ids, x, _):
            nrm = np.sqrt(np.einsum("ij,ij->i", x, x))
            xn = np.divide(x, nrm[:, None], out=np.zeros_like(x), where=nrm[:, None] > 0)
            acc = np.zeros((len(ids), len(keys)))
            for r in range(cents.shape[0]):
                z = tau * (xn @ cents[r].T)
                z = z - z.max(axis=1, keepdims=True)
                acc += np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            p = acc / cents.shape[0]
            return pd.DataFrame({"id": ids, "score": p[:, ood_idx] if ood_idx is not None else p.max(axis=1)})

        return V.score_rows(df, fn, "id long, score double")


def _uniform_hash(ids: np.ndarray, r: int, d: int) -> np.ndarray:
    """Deterministic uniforms in [0, 1) per (id, pass, dim): two rounds of a
    multiplicative hash modulo the prime 2^31 - 1 (exact in 64-bit integers,
    so SQL engines reproduce it)."""
    p = HASH_PRIME
    h0 = np.mod(ids.astype(np.int64), p)
    h1 = np.mod(h0[:, None] * HASH_A + r * HASH_B + np.arange(d, dtype=np.int64)[None, :] * HASH_C, p)
    h2 = np.mod(h1 * HASH_A2 + HASH_C2, p)
    return h2.astype(np.float64) / float(p)


class GaussianNB:
    """Gaussian naive Bayes head: per-class means and population variances
    (+ var_smoothing x the largest per-feature variance of all rows), class
    priors from counts; lexically ordered classes, first class on ties."""

    def __init__(self, var_smoothing: float = 1e-9, label: str = "intent"):
        self.var_smoothing, self.label = var_smoothing, label

    def fit(self, train: DataFrame) -> "GaussianNB":
        long = train.select(F.col(self.label).alias("cls"), F.posexplode("v").alias("pos", "x"))
        stats = long.groupBy("cls", "pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s2"))
        keys, self.theta = V.collect_matrix(stats.select(F.col("cls").alias(self.label), "pos", F.col("m").alias("value")),
                                            self.label)
        _, var = V.collect_matrix(stats.select(F.col("cls").alias(self.label), "pos", F.col("s2").alias("value")),
                                  self.label)
        gvar = long.groupBy("pos").agg(F.var_pop("x").alias("g")).agg(F.max("g")).first()[0]
        self.var = var + self.var_smoothing * float(gvar)
        counts = {r[self.label]: r["n"] for r in train.groupBy(self.label).agg(F.count(F.lit(1)).alias("n")).collect()}
        n = sum(counts.values())
        self.keys = keys
        self.log_prior = np.log(np.array([counts[k] / n for k in keys]))
        return self

    def joint_log_likelihood(self, x: np.ndarray) -> np.ndarray:
        const = -0.5 * np.log(2.0 * np.pi * self.var).sum(axis=1)
        quad = (((x[:, None, :] - self.theta[None, :, :]) ** 2) / self.var[None, :, :]).sum(-1)
        return self.log_prior[None, :] + const[None, :] - 0.5 * quad

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, pred, prob) with prob the posterior of the predicted class."""
        keys = np.array(self.keys, dtype=object)
        me = self

        def fn(ids, x, _):
            jll = me.joint_log_likelihood(x)
            b = np.argmax(jll, axis=1)
            z = jll - jll.max(axis=1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            return pd.DataFrame({"id": ids, "pred": keys[b], "prob": p[np.arange(len(b)), b]})

        return V.score_rows(df, fn, "id long, pred string, prob double")


class LogitsMSPScore(_HeadDetector):
    """1 - max softmax(logits / T) of the head (registered as 'max')."""
    name = "msp_score"

    def __init__(self, ood_label: str = OOD_LABEL, temperature: float = 1.0):
        super().__init__(ood_label)
        self.score_temperature = temperature

    def _from_probs(self, p, head, x):
        z = head.logits(x) / self.score_temperature
        z = z - z.max(axis=1, keepdims=True)
        return 1.0 - (np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)).max(axis=1)


class LogitsEntropyScore(LogitsMSPScore):
    """Exact categorical entropy of softmax(logits / T) (registered as 'entropy')."""
    name = "entropy_score"

    def _from_probs(self, p, head, x):
        z = head.logits(x) / self.score_temperature
        z = z - z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -(np.exp(logp) * logp).sum(axis=1)


def logits_msp_score(df: DataFrame, head: CentroidHead, temperature: float = 1.0) -> DataFrame:
    """1 - max softmax(logits / T)."""
    def fn(ids, x, _):
        z = head.logits(x) / temperature
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return pd.DataFrame({"id": ids, "score": 1.0 - p.max(axis=1)})
    return V.score_rows(df, fn, "id long, score double")


def logits_entropy_score(df: DataFrame, head: CentroidHead, temperature: float = 1.0) -> DataFrame:
    """Exact categorical entropy of softmax(logits / T)."""
    def fn(ids, x, _):
        z = head.logits(x) / temperature
        z = z - z.max(axis=1, keepdims=True)
        lse = np.log(np.exp(z).sum(axis=1, keepdims=True))
        logp = z - lse
        return pd.DataFrame({"id": ids, "score": -(np.exp(logp) * logp).sum(axis=1)})
    return V.score_rows(df, fn, "id long, score double")


class ADB:
    """Adaptive decision boundary: nearest centroid of L2-normalised vectors;
    class if distance < class radius, else the OOD label.  Labels only."""
    name = "adb"

    def __init__(self, ood_label: str = OOD_LABEL, alpha: float = 0.75, step: float = 0.01):
        self.ood_label, self.alpha, self.step = ood_label, alpha, step

    def fit(self, train: DataFrame) -> "ADB":
        self.centroids = V.class_centroids(train)
        self.radius = V.adb_radius(train, self.centroids, alpha=self.alpha, step=self.step)
        self.centroids = written(self.centroids, "centroids")
        self.fits = V.class_state_fits(self.centroids, "intent")
        if self.fits:
            self.keys, self.cmat = V.collect_matrix(self.centroids, "intent")
            rad = {r["intent"]: float(r["radius"]) for r in self.radius.collect()}  # one row per class
            self.rvec = np.array([rad[k] for k in self.keys])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if not self.fits:
            return within_radius_of_many(df, self.centroids, self.radius, self.ood_label)
        keys, cmat, rvec, ood = np.array(self.keys, dtype=object), self.cmat, self.rvec, self.ood_label

        def fn(ids, x, _):
            nrm = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x), 1e-12))
            d = np.sqrt(V.square_distances(x / nrm[:, None], cmat))
            b = np.argmin(d, axis=1)
            dist = d[np.arange(len(b)), b]
            pred = np.where(dist < rvec[b], keys[b], ood)
            return pd.DataFrame({"id": ids, "pred": pred, "dist": dist})

        return V.score_rows(df, fn, "id long, pred string, dist double")


REGISTRY = {
    "knn": KNN, "euclidean_nn": EuclideanNN, "cosine_nn": CosineNN, "cosine_entropy": CosineEntropy,
    "pca_cosine": PCACosine, "pca_euclidean": PCAEuclidean, "pca_entropy": PCAEntropy,
    "maha": Mahalanobis, "lof": LOF, "trust_score": TrustScore, "entropy": Entropy, "msp": MSP,
    "binary_msp": BinaryMSP, "doc": DOC, "mc_dropout": MCDropout, "class_euclidean": ClassEuclidean,
    "class_maha": ClassMahalanobis, "class_maha_pca": ClassMahalanobisPCA,
    "marginal_maha": MarginalMahalanobis, "marginal_maha_pca": MarginalMahalanobisPCA,
    "bnn_bootstrap": BootstrapHead,
}


def get_detector(name: str, **kwargs) -> Detector:
    try:
        return REGISTRY[name](**kwargs)
    except KeyError:
        raise ValueError(f"unknown detector {name!r}; known: {sorted(REGISTRY)}") from None
