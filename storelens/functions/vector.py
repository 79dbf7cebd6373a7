"""Vector arithmetic on array<float|double> columns (no vector type in PySpark)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    sq = F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq)


def cosine_similarity(a, b) -> Column:
    """1 - cosine distance, in [-1, 1].  Zero vectors give NULL (not an error)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
