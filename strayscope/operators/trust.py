"""Training-set filters of the trust score: density (k-th neighbour radius
within the class) and uncertainty (own-class share among the k nearest
training rows).  Both keep rows against an exact percentile cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import exact_percentile
from .pairs import NearestOp, pair_scan

TRUST_K = 10


def knn_radius_in_class(train: DataFrame, k: int = TRUST_K) -> DataFrame:
    """(id, intent, radius): distance to the k-th nearest row of the same class,
    the row itself included (rank 1, distance 0); the farthest available when
    the class has fewer than k rows."""
    q = train.select("id", "v", "intent", F.col("intent").alias("qlabel"))
    nn = pair_scan(q, train.select("id", "v", "intent"), NearestOp(k, "l2", same_label=True), label_col="intent")
    r = nn.groupBy("qid").agg(F.max_by("value", "rank").alias("radius"))
    return r.join(train.select(F.col("id").alias("qid"), "intent"), "qid").select(F.col("qid").alias("id"), "intent", "radius")


def density_filter(train: DataFrame, alpha: float, k: int = TRUST_K) -> DataFrame:
    """Rows whose in-class k-NN radius is <= the class's (1 - alpha) percentile."""
    rad = knn_radius_in_class(train, k).cache()
    eps = exact_percentile(rad, "radius", 1.0 - alpha, group="intent")
    kept = rad.join(eps, "intent").filter(F.col("radius") <= F.col("pct")).select("id")
    return train.join(kept, "id", "left_semi")


def own_class_share(train: DataFrame, k: int = TRUST_K) -> DataFrame:
    """(id, share): fraction of the k nearest training rows (self included)
    that carry the row's own label (ties by id)."""
    nn = pair_scan(train, train.select("id", "v", "intent"), NearestOp(k, "l2"), label_col="intent")
    own = nn.join(train.select(F.col("id").alias("qid"), F.col("intent").alias("own")), "qid")
    return own.groupBy("qid").agg((F.count_if(F.col("ref_label") == F.col("own")) / F.count(F.lit(1))).alias("share")) \
        .select(F.col("qid").alias("id"), "share")


def uncertainty_filter(train: DataFrame, alpha: float, k: int = TRUST_K) -> DataFrame:
    """Rows whose own-class share is >= the alpha percentile of all shares."""
    share = own_class_share(train, k).cache()
    cut = exact_percentile(share, "share", alpha).first()["pct"]
    return train.join(share.filter(F.col("share") >= F.lit(cut)).select("id"), "id", "left_semi")
