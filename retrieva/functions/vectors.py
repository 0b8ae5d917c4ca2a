"""Vector column expressions (T9, T11; T10 is in the block scorer of ``operators.dense``). Arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def as_double(v) -> Column:
    return col(v).cast("array<double>")


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector stays all-null-free zeros -> nulls guarded."""
    n = l2_norm(v)
    return F.transform(as_double(v), lambda x: F.coalesce(x / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def inverse_distance(d) -> Column:
    """Distance -> similarity 1/(1+d)."""
    return F.lit(1.0) / (F.lit(1.0) + col(d))
