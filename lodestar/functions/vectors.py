"""Vector column functions (V1-V3, V15) as higher-order SQL functions.

Computation is in double: float32 inputs are cast before multiplying so results agree with other
engines after rounding. These are for row-wise use on already-paired rows; bulk products over
many pairs use the numpy block kernels of ``operators.vectors``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(v: str | Column) -> Column:
    return _c(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    """V1: inner product."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """V2: dot / (|a| |b|); null when a norm is 0."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def l2_normalize(a: str | Column) -> Column:
    """V3: ``a / |a|`` (a zero vector stays zero). The norm is the accumulator of ``aggregate``
    and is used in its finish function, so it is computed once per vector (a norm column used
    inside a lambda would be inlined and recomputed per element)."""
    v = as_double(a)
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x,
                       lambda acc: F.transform(v, lambda x: F.when(acc > 0, x / F.sqrt(acc)).otherwise(F.lit(0.0))))


def sq_l2(a: str | Column, b: str | Column) -> Column:
    """Squared euclidean distance."""
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def bucketize(x: Column, cutoffs: Column) -> Column:
    """Number of cutoffs strictly below ``x``."""
    return F.aggregate(cutoffs, F.lit(0), lambda acc, c: acc + F.when(c < x, 1).otherwise(0))
