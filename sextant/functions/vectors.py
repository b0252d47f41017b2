"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: (x / F.when(n > 0, n).otherwise(1.0)).cast("float"))


def score_of_distance(d: Column, metric: str) -> Column:
    """A score in [0, 1]: cosine 1-d, l2 1/(1+d) (d squared, negative ones count as 0), ip -d, otherwise 1-d."""
    s = {"cosine": 1 - d, "l2": 1 / (1 + F.greatest(d, F.lit(0.0))), "ip": -d}.get(metric, F.greatest(F.lit(0.0), 1 - d))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
