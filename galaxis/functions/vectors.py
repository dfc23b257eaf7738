"""Column expressions on vectors (arrays of doubles). They stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of norms in a cosine distance, so that a zero vector has distance 1 from all others.
COSINE_EPS = 1e-8


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_euclidean(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def cosine(a: str | Column, b: str | Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b) + COSINE_EPS)


def cosine_plain(a: str | Column, b: str | Column) -> Column:
    """Cosine distance where a zero vector has distance 0, and rounding never makes one negative."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(a, b) / scale))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}


def distance(a: str | Column, b: str | Column, metric: str = "euclidean") -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}, not {metric!r}")
    return DISTANCES[metric](a, b)


def normalized(a: str | Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, _col(a)).otherwise(F.transform(_col(a), lambda x: x / size))


def rbf(distance_: Column, gamma: float) -> Column:
    return F.exp(-gamma * distance_ * distance_)


def comb2(n: Column) -> Column:
    return n * (n - 1) / 2


def inverse(distance_: Column) -> Column:
    """lambda = 1 / distance, infinite at 0."""
    return F.when(distance_ > 0, 1 / distance_).otherwise(F.lit(float("inf")))


def lance_williams(linkage: str, ik: Column, jk: Column, ij: Column, ni: Column, nj: Column, nk: Column) -> Column:
    """The distance of cluster k to the union of i and j."""
    if linkage == "single":
        return F.least(ik, jk)
    if linkage == "complete":
        return F.greatest(ik, jk)
    if linkage == "average":
        return (ni * ik + nj * jk) / (ni + nj)
    if linkage == "ward":
        return F.sqrt(((ni + nk) * ik * ik + (nj + nk) * jk * jk - nk * ij * ij) / (ni + nj + nk))
    raise ValueError(f"unknown linkage {linkage!r}")


def neighborhood(kind: str, d: Column, radius: float) -> Column:
    """The influence of a neuron at grid distance d from a sample's best neuron."""
    if kind == "gaussian":
        return F.exp(-(d * d) / (2 * radius * radius))
    if kind == "bubble":
        return F.when(d <= radius, 1.0).otherwise(0.0)
    if kind == "mexican_hat":
        r = d * d / (radius * radius)
        return 2 * (1 - r) * F.exp(-r / 2)
    raise ValueError(f"unknown neighborhood {kind!r}")
