"""Vector aggregations: class centroids/means, covariance, PCA basis, ADB radius,
and row-wise scorers against small fitted state.

Per-class and global statistics are computed with partial (map-side)
aggregation: a d-wide vector contributes d (class, pos) partial sums per
partition, so the shuffle is partitions x classes x d values, independent of
the row count.  Second moments (d x d) are summed per partition in numpy and
tree-reduced with ``coalesce`` so at most a handful of d x d partials reach
the driver, where inverses and eigen-decompositions (d x d only) are done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MAX_STATE_BYTES = 512 << 20  # of a d x d matrix, or of weights, that every task gets
CLASS_STATE_BYTES = 128 << 20  # of class vectors; more of them stay distributed (``operators.classes``)
TREE_FAN_IN = 16


def _check_state(nbytes: int, what: str) -> None:
    if nbytes > MAX_STATE_BYTES:
        raise ValueError(f"{what} needs {nbytes} bytes of broadcast state, above the {MAX_STATE_BYTES} limit")


def class_state_fits(long: DataFrame, key: str) -> bool:
    """Whether the class vectors of (key, pos, value) may go to every task."""
    stats = long.agg(F.countDistinct(key).alias("k"), (F.max("pos") + 1).alias("d")).first()
    return int(stats["k"] or 0) * int(stats["d"] or 0) * 8 <= CLASS_STATE_BYTES


def _class_sum_partials(df: DataFrame, label: str | None, vec: str, normalize_rows: bool) -> DataFrame:
    """Per input partition and class: component sums and row count, computed in
    numpy (rows optionally L2-normalised with the 1e-12 epsilon).  Output is
    long form (label, pos, s, n): partitions x classes x d rows, independent
    of the row count - the map-side combine of a per-class mean."""
    def part(it):
        acc: dict = {}
        for pdf in it:
            pdf = pdf[pdf["v"].notna()]
            if len(pdf) == 0:
                continue
            x = np.vstack([np.asarray(a, dtype=np.float64) for a in pdf["v"].values])
            if normalize_rows:
                x = x / np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x), 1e-12))[:, None]
            labs = pdf["label"].to_numpy(dtype=object) if label else np.full(len(pdf), "", dtype=object)
            for c in pd.unique(labs):
                m = labs == c
                s_, n_ = acc.get(c, (0.0, 0))
                acc[c] = (s_ + x[m].sum(axis=0), n_ + int(m.sum()))
        if acc:
            rows = [(c, j, float(v), n) for c, (sv, n) in acc.items() for j, v in enumerate(sv)]
            yield pd.DataFrame(rows, columns=["label", "pos", "s", "n"])

    cols = [F.col(vec).alias("v")] + ([F.col(label).cast("string").alias("label")] if label else [])
    return df.select(*cols).mapInPandas(part, "label string, pos int, s double, n long")


def class_vector_means(df: DataFrame, label: str = "intent", vec: str = "v", normalize_rows: bool = False,
                       normalize_result: bool = False) -> DataFrame:
    """Long form (label, pos, value) of per-class component means (optionally of
    L2-normalised rows, optionally re-normalised per class)."""
    parts = _class_sum_partials(df, label, vec, normalize_rows)
    means = parts.groupBy("label", "pos").agg((F.sum("s") / F.sum("n")).alias("value"))
    if normalize_result:
        norm = means.groupBy("label").agg(F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")),
                                                            F.lit(1e-12))).alias("nrm"))
        means = means.join(norm, "label").select("label", "pos", (F.col("value") / F.col("nrm")).alias("value"))
    return means.withColumnRenamed("label", label)


def class_centroids(df: DataFrame, label: str = "intent", vec: str = "v") -> DataFrame:
    """Mean of L2-normalised rows per class, re-normalised (long form)."""
    return class_vector_means(df, label, vec, normalize_rows=True, normalize_result=True)


def global_mean(df: DataFrame, vec: str = "v") -> DataFrame:
    """Long form (pos, value) of the component means (per-partition numpy sums)."""
    parts = _class_sum_partials(df, None, vec, False)
    return parts.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("value"))


def long_to_vectors(long: DataFrame, key: str | None) -> DataFrame:
    """(key, pos, value) -> (key, v array ordered by pos); one row per key."""
    keys = [key] if key else []
    agg = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_a"))
    return agg.select(*keys, F.transform("_a", lambda s: s["value"]).alias("v"))


def collect_matrix(long: DataFrame, key: str) -> tuple[list[str], np.ndarray]:
    """Small (key, pos, value) state -> (sorted keys, matrix); the caller has checked its size."""
    pdf = long.toPandas()
    keys = sorted(pdf[key].unique().tolist())
    d = int(pdf["pos"].max()) + 1 if len(pdf) else 0
    mat = np.zeros((len(keys), d))
    idx = {k: i for i, k in enumerate(keys)}
    mat[pdf[key].map(idx).to_numpy(), pdf["pos"].to_numpy()] = pdf["value"].to_numpy()
    return keys, mat


def collect_vector(long: DataFrame) -> np.ndarray:
    pdf = long.toPandas().sort_values("pos")
    _check_state(len(pdf) * 8, "vector state")
    return pdf["value"].to_numpy(dtype=np.float64)


# ------------------------------------------------------------ second moments

def _gram_partials(df: DataFrame, vec: str, center_by: dict | np.ndarray | None, label: str | None) -> DataFrame:
    """One row per input partition: n, sum of rows, flattened sum of outer products
    of (row - centre)."""
    def part(it):
        n, s, g = 0, None, None
        for pdf in it:
            pdf = pdf[pdf["v"].notna()]
            if len(pdf) == 0:
                continue
            x = np.vstack([np.asarray(a, dtype=np.float64) for a in pdf["v"].values])
            if isinstance(center_by, dict):
                cen = np.vstack([center_by[c] for c in pdf["label"].values])
                x = x - cen
            elif center_by is not None:
                x = x - center_by[None, :]
            if s is None:
                s, g = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
            n += len(x)
            s += x.sum(axis=0)
            g += x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    cols = [F.col(vec).alias("v")] + ([F.col(label).cast("string").alias("label")] if label else [])
    return df.select(*cols).mapInPandas(part, "n long, s array<double>, g array<double>")


def _tree_sum(partials: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    def add(it):
        n, s, g = 0, None, None
        for pdf in it:
            for row in pdf.itertuples(index=False):
                vs, vg = np.asarray(row.s), np.asarray(row.g)
                s = vs if s is None else s + vs
                g = vg if g is None else g + vg
                n += int(row.n)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.tolist()]})

    # shuffled levels, so that the scan keeps its own parallelism; each task streams its partials,
    # about the square root of them, and a scan of few tasks needs no level
    tasks = partials.rdd.getNumPartitions()
    while tasks > TREE_FAN_IN:
        tasks = math.ceil(math.sqrt(tasks))
        partials = (partials.withColumn("_k", F.spark_partition_id() % tasks).repartition(tasks, "_k").drop("_k")
                    .mapInPandas(add, "n long, s array<double>, g array<double>"))
    rows = partials.collect()  # at most TREE_FAN_IN rows of d*d doubles
    if not rows:
        raise ValueError("no vectors to aggregate")
    n = sum(int(r["n"]) for r in rows)
    s = np.sum([np.asarray(r["s"]) for r in rows], axis=0)
    g = np.sum([np.asarray(r["g"]) for r in rows], axis=0)
    d = len(s)
    return n, s, g.reshape(d, d)


def mean_vector(df: DataFrame, vec: str = "v") -> np.ndarray:
    return collect_vector(global_mean(df, vec))


def covariance(df: DataFrame, vec: str = "v", ddof: int = 1, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) with the rows centred on their mean first (two passes)."""
    mu = mean_vector(df, vec) if mean is None else mean
    _check_state(len(mu) * len(mu) * 8, "covariance")
    n, s, g = _tree_sum(_gram_partials(df, vec, mu, None))
    return mu, g / (n - ddof), n


def pooled_class_covariance(df: DataFrame, class_means: dict[str, np.ndarray], vec: str = "v",
                            label: str = "intent", ddof: int = 0) -> tuple[np.ndarray, int]:
    """Sum over rows of (x - mu_class)(x - mu_class)^T / (n - ddof)."""
    d = len(next(iter(class_means.values())))
    _check_state(d * d * 8 + len(class_means) * d * 8, "pooled covariance")
    n, s, g = _tree_sum(_gram_partials(df, vec, class_means, label))
    return g / (n - ddof), n


def covariance_long(cov: np.ndarray, spark) -> DataFrame:
    i, j = np.indices(cov.shape)
    pdf = pd.DataFrame({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "cov": cov.ravel()})
    return spark.createDataFrame(pdf)


def pca_basis(df: DataFrame, vec: str = "v", tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All principal components of non-zero variance: (mean, basis d x r, variances r)."""
    mu, cov, n = covariance(df, vec, ddof=1)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    keep = w > tol * max(float(w[0]), 1e-300)
    return mu, v[:, keep], w[keep]


# --------------------------------------------------------------- row scorers

def score_rows(df: DataFrame, fn, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn(ids, matrix, pdf) -> DataFrame`` per Arrow batch (vectorised numpy).

    ``fn`` closes over small fitted state (size-checked by the caller).  Rows
    with a null vector produce no output row (same contract as the pair
    engine: no vector, no score)."""
    cols = [F.col("id").cast("long").alias("id"), F.col("v")] + [F.col(c) for c in keep]

    def run(it):
        for pdf in it:
            ok = pdf["v"].notna().to_numpy()
            if not ok.any():
                continue
            ids = pdf["id"].to_numpy(dtype=np.int64)[ok]
            x = np.vstack([np.asarray(a, dtype=np.float64) for a in pdf["v"].values[ok]])
            out = fn(ids, x, pdf[ok].reset_index(drop=True))
            if out is not None and len(out):
                yield out

    return df.select(*cols).mapInPandas(run, schema)


def quadratic_scores(df: DataFrame, mean: np.ndarray, weight: np.ndarray, sqrt: bool) -> DataFrame:
    """(id, score) with score = (x - mean)^T W (x - mean) [sqrt when asked]."""
    _check_state(weight.nbytes + mean.nbytes, "quadratic form")

    def fn(ids, x, _):
        c = x - mean[None, :]
        q = np.einsum("ij,ij->i", c @ weight, c)
        if sqrt:
            q = np.sqrt(np.maximum(q, 0.0))
        return pd.DataFrame({"id": ids, "score": q})

    return score_rows(df, fn, "id long, score double")


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """|x - y|^2 of all pairs by the expanded form (no rows x classes x d array), each row's
    nearest one in full, so that equal vectors have distance 0."""
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2.0 * (x @ y.T)
    best = np.argmin(d2, axis=1)
    diff = x - y[best]
    d2[np.arange(len(x)), best] = np.einsum("ij,ij->i", diff, diff)
    return np.maximum(d2, 0.0)


def adb_radius(points: DataFrame, centroid_long: DataFrame, label: str = "intent", vec: str = "v",
               alpha: float = 0.75, step: float = 0.01, cap: float = 2.0) -> DataFrame:
    """Per-class decision radius of the adaptive decision boundary.

    The reference walks r = 0, step, 2*step, ... and stops at the first r whose
    criterion mean(ood*(d-r)) - mean(id*(r-d))*per/alpha is negative.  The
    criterion is linear in r, so the stop point is closed form:
    r* = (S_ood + S_id*per/alpha) / (n_ood*(1 + 1/alpha)), radius =
    floor(r*/step)*step, capped at ``cap`` (2 = diameter of the unit sphere;
    also the answer when a class has no other-class rows).  S are sums of
    distances of all points to the class centroid.
    """
    centroid_long = written(centroid_long, "centroids")
    if not class_state_fits(centroid_long, label):
        from .classes import distance_sums
        return _radius(distance_sums(points, centroid_long, label, vec), label, alpha, step, cap)
    keys, cmat = collect_matrix(centroid_long, label)
    spark = points.sparkSession

    def fn(ids, x, pdf):
        nrm = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x), 1e-12))
        xn = x / nrm[:, None]
        lab = pdf["lab"].to_numpy(dtype=object)
        rows = []
        for ci, c in enumerate(keys):
            dist = np.sqrt(np.einsum("ij,ij->i", xn - cmat[ci], xn - cmat[ci]))
            own = lab == c
            rows.append((c, float(dist[own].sum()), int(own.sum()), float(dist[~own].sum()), int((~own).sum())))
        return pd.DataFrame(rows, columns=["cls", "s_id", "n_id", "s_ood", "n_ood"]).assign(id=0)

    partial = score_rows(points.withColumn("lab", F.col(label).cast("string")), fn,
                         "cls string, s_id double, n_id long, s_ood double, n_ood long, id long", keep=("lab",))
    return _radius(partial.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("s_id", "n_id", "s_ood", "n_ood")]), label, alpha, step, cap)


def _radius(tot: DataFrame, label: str, alpha: float, step: float, cap: float) -> DataFrame:
    per = F.col("n_ood") / F.col("n_id")
    r_star = (F.col("s_ood") + F.col("s_id") * per / F.lit(alpha)) / (F.col("n_ood") * (1.0 + 1.0 / alpha))
    radius = F.when(F.col("n_ood") == 0, F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.floor(r_star / F.lit(step)) * F.lit(step)))
    return tot.select(F.col("cls").alias(label), radius.alias("radius"))


def nearest_centroid(df: DataFrame, centroid_long: DataFrame, label: str = "intent") -> DataFrame:
    """Nearest class centroid under Euclidean, cosine (1 - cos) and angular
    (acos(cos)/pi) distance; ties -> lexically first class.  The centroid
    matrix is classes x d and applied per Arrow batch, or, if it is large, dealt into
    blocks that meet the rows in the pair engine."""
    centroid_long = written(centroid_long, "centroids")
    if not class_state_fits(centroid_long, label):
        from .classes import nearest_of_many
        return nearest_of_many(df, centroid_long, label)
    keys, cmat = collect_matrix(centroid_long, label)
    keys = np.array(keys, dtype=object)
    cn = np.sqrt(np.einsum("ij,ij->i", cmat, cmat))

    def fn(ids, x, _):
        d_e = np.sqrt(square_distances(x, cmat))
        xn = np.sqrt(np.einsum("ij,ij->i", x, x))
        den = xn[:, None] * cn[None, :]
        cos = np.divide(x @ cmat.T, den, out=np.zeros_like(den), where=den > 0)
        d_c = 1.0 - cos
        d_a = np.arccos(np.clip(cos, -1.0, 1.0)) / np.pi
        out = {"id": ids}
        for nm, d in (("euclidean", d_e), ("cosine", d_c), ("angular", d_a)):
            b = np.argmin(d, axis=1)
            out[f"pred_{nm}"] = keys[b]
            out[f"d_{nm}"] = d[np.arange(len(b)), b]
        return pd.DataFrame(out)

    return score_rows(df, fn, "id long, pred_euclidean string, d_euclidean double, pred_cosine string, "
                              "d_cosine double, pred_angular string, d_angular double")
