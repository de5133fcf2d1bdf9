"""Vector expressions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
