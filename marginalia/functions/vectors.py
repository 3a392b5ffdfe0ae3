"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column, least: float = 0.1) -> Column:
    """The vector at length 1; null where its length is under ``least``."""
    return F.when(norm(v) >= least, F.transform(v, lambda x: x.cast("double") / norm(v)))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance; on unit vectors 2 - 2 cos."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, d: s + d * d)
