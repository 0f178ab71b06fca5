"""Class vectors (centroids, means) of any number of classes.

While the class vectors are few bytes, the operators send them to every task
(``vectors``, ``detectors``).  Beyond that they stay a table: what needs the nearest class, or a sum
over all rows for each class, meets it block by block in the pair engine; what needs a row's own
class joins it by label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import vectors as V
from .metrics import global_row_number
from .pairs import DistanceSumOp, NearestOp, pair_scan


def numbered_classes(vectors: DataFrame, label: str = "intent") -> DataFrame:
    """(id, v, label) of class vectors, ids in lexical order (so ties go to the first)."""
    return global_row_number(vectors, [F.col(label).asc()], "id").select(F.col("id").cast("long").alias("id"), "v", label)


def class_table(long: DataFrame, label: str = "intent") -> DataFrame:
    return written(numbered_classes(V.long_to_vectors(long, label), label), "classes")


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x), F.lit(1e-12)))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n))[0]


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def nearest_of_many(df: DataFrame, long: DataFrame, label: str = "intent") -> DataFrame:
    """``vectors.nearest_centroid`` with the centroids as the reference side of the pair engine."""
    classes = class_table(long, label)
    rows = df.select("id", "v")
    e = pair_scan(rows, classes, NearestOp(1, "l2"), label_col=label, broadcast_bytes=V.CLASS_STATE_BYTES)
    c = pair_scan(rows, classes, NearestOp(1, "cosine_dist"), label_col=label, broadcast_bytes=V.CLASS_STATE_BYTES)
    e = e.select(F.col("qid").alias("id"), F.col("ref_label").alias("pred_euclidean"), F.col("value").alias("d_euclidean"))
    near = F.col("value")
    c = c.select(F.col("qid").alias("id"), F.col("ref_label").alias("pred_cosine"), near.alias("d_cosine"), F.col("ref_label").alias("pred_angular"),
                 (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - near))) / F.lit(np.pi)).alias("d_angular"))
    return e.join(c, "id")


def distance_sums(points: DataFrame, long: DataFrame, label: str = "intent", vec: str = "v") -> DataFrame:
    """(cls, s_id, n_id, s_ood, n_ood): for each class the distances of its own and of all other
    unit rows to its centroid, summed."""
    classes = class_table(long, label)
    rows = points.filter(F.col(vec).isNotNull()).select("id", _unit(F.col(vec)).alias("v"), F.col(label).cast("string").alias("cls"))
    rows = written(rows, "unit-rows")
    center = classes.select(F.col(label).alias("cls"), F.col("v").alias("c"))
    own = rows.join(center, "cls").groupBy("cls").agg(F.sum(_norm(_minus(F.col("v"), F.col("c")))).alias("s_id"), F.count(F.lit(1)).alias("n_id"))
    every = DistanceSumOp().merge(pair_scan(rows, classes, DistanceSumOp(), label_col=label, broadcast_bytes=V.CLASS_STATE_BYTES))
    found = every.join(own, F.col("cls") == F.col("ref_label"))
    return found.select("cls", "s_id", "n_id", (F.col("s") - F.col("s_id")).alias("s_ood"), (F.col("n") - F.col("n_id")).alias("n_ood"))


def within_radius_of_many(df: DataFrame, long: DataFrame, radius: DataFrame, ood_label: str, label: str = "intent") -> DataFrame:
    """(id, pred, dist): the nearest class if the unit row lies within its radius."""
    classes = class_table(long, label)
    rows = df.filter(F.col("v").isNotNull()).select("id", _unit(F.col("v")).alias("v"))
    near = pair_scan(rows, classes, NearestOp(1, "l2"), label_col=label, broadcast_bytes=V.CLASS_STATE_BYTES)
    met = near.join(radius.select(F.col(label).alias("ref_label"), "radius"), "ref_label")
    pred = F.when(F.col("value") < F.col("radius"), F.col("ref_label")).otherwise(ood_label)
    return met.select(F.col("qid").alias("id"), pred.alias("pred"), F.col("value").alias("dist"))


def residuals_of_many(df: DataFrame, long: DataFrame, label: str = "intent") -> DataFrame:
    """(id, v): rows less the class mean that is nearest to them."""
    classes = class_table(long, label)
    near = pair_scan(df.select("id", "v"), classes, NearestOp(1, "l2"), label_col=label, broadcast_bytes=V.CLASS_STATE_BYTES)
    met = df.select("id", "v").join(near.select(F.col("qid").alias("id"), "ref_id"), "id")
    met = met.join(classes.select(F.col("id").alias("ref_id"), F.col("v").alias("c")), "ref_id")
    return met.select("id", _minus(F.col("v"), F.col("c")).alias("v"))


def class_residual_moments(train: DataFrame, ddof: int, label: str = "intent") -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, sum of squares / (n - ddof), n) of the rows less their class mean."""
    long = written(V.class_vector_means(train, label), "class-means")
    if V.class_state_fits(long, label):
        keys, mat = V.collect_matrix(long, label)
        n, s, g = V._tree_sum(V._gram_partials(train, "v", dict(zip(keys, mat)), label))
    else:
        classes = class_table(long, label).select(F.col(label).alias("cls"), F.col("v").alias("c"))
        rows = train.filter(F.col("v").isNotNull()).withColumn("cls", F.col(label).cast("string")).join(classes, "cls")
        n, s, g = V._tree_sum(V._gram_partials(rows.select(_minus(F.col("v"), F.col("c")).alias("v")), "v", None, None))
    return s / n, g / (n - ddof), n
