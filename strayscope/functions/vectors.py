"""Column expressions on ``array<double>`` vectors (JVM-side, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: epsilons of the reference maths
L2_EPSILON = 1e-12


def as_double_vector(col: str | Column) -> Column:
    return F.transform(col, lambda x: x.cast("double"))


def sum_squares(col: str | Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(col: str | Column) -> Column:
    return F.sqrt(sum_squares(col))


def l2_normalize(col: str | Column, epsilon: float = L2_EPSILON) -> Column:
    """x / sqrt(max(sum(x^2), epsilon))."""
    c = F.col(col) if isinstance(col, str) else col
    inv = 1.0 / F.sqrt(F.greatest(sum_squares(c), F.lit(epsilon)))
    return F.transform(c, lambda x: x * inv)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, x: acc + x))


def angular(a: str | Column, b: str | Column) -> Column:
    """acos(clipped cosine) / pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / F.lit(math.pi)


def vector_long_form(df, id_cols: list[str], vec: str = "v"):
    """(ids..., pos, value) rows of a vector column (0-based pos)."""
    return df.select(*id_cols, F.posexplode(vec).alias("pos", "value"))
