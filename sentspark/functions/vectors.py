"""Vector expressions over ``array<double>`` columns.

Spark 4.1 has no native vector functions, so these are higher-order
functions (``zip_with`` + ``aggregate``); they run inside the JVM with no
Python round trip.  ``array<float>`` inputs are cast to double first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# torch's default eps for cosine similarity
COSINE_EPS = 1e-8
# Default contrastive temperature of the reference.
TEMPERATURE = 0.05


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def broadcast_scalar(s: Column, like) -> Column:
    """``s`` repeated to the length of array ``like``.

    Catalyst inlines a per-row value into the lambda that uses it, so
    ``transform(a, x -> x / norm(a))`` recomputes ``norm(a)`` for every
    element (quadratic).  ``zip_with(a, broadcast_scalar(norm(a), a), ...)``
    evaluates it once per row: only the lambda body runs per element.
    """
    return F.array_repeat(s, F.size(_c(like)))


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def vsum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Sum of products."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def manhattan(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def euclidean(a, b) -> Column:
    return F.sqrt(vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def cos_temp(a, b, temp: float = TEMPERATURE, eps: float = COSINE_EPS) -> Column:
    """V6: cos(a, b) / temp with the product of norms clamped at eps
    (a zero vector scores 0)."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps)) / F.lit(temp)


def normalize(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.zip_with(_c(a), broadcast_scalar(norm(a), a),
                      lambda x, n: F.when(n > F.lit(0.0), x / n).otherwise(F.lit(0.0)))


def paired_cosine(a, b) -> Column:
    """``1 - ||a/|a| - b/|b|||^2 / 2``; cosine for non-zero vectors,
    0.5 with one zero vector, 1 with two."""
    return F.lit(1.0) - F.lit(0.5) * vsum(F.zip_with(normalize(a), normalize(b), lambda x, y: (x - y) * (x - y)))


def neg_manhattan(a, b) -> Column:
    """Negative L1 distance."""
    return -manhattan(a, b)


def neg_euclidean(a, b) -> Column:
    """Negative L2 distance."""
    return -euclidean(a, b)
