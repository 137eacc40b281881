"""Distances between vector columns as Spark expressions.

Short vectors are unrolled to one arithmetic expression, which stays inside
whole-stage code generation; longer ones use array functions.  Components are
cast to DOUBLE before they are subtracted.  ``l2`` is the true distance, ``l2sq``
its square; both exist because approximate inverted-file search ranks by the square.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinage.functions.binary import hamming_words

#: Dimensions up to which an expression is unrolled; beyond it generated code grows too large.
UNROLL = 128

NAMES = {
    "l2": "l2", "euclidean": "l2", "l2sq": "l2sq", "sqeuclidean": "l2sq",
    "l1": "l1", "manhattan": "l1", "linf": "linf", "chebyshev": "linf", "hamming": "hamming",
}


def resolve(metric: str) -> str:
    """Canonical name of a metric, in any case; raises ``ValueError`` otherwise."""
    try:
        return NAMES[metric.lower()]
    except KeyError:
        raise ValueError(f"Unsupported metric: {metric!r}; one of {sorted(NAMES)}") from None


def _parts(a: Column, b: Column, dim: int) -> list[Column]:
    return [a[i].cast("double") - b[i].cast("double") for i in range(dim)]


def _fold(a: Column, b: Column, part: Callable[[Column], Column]) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: part(x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and dim <= UNROLL:
        return reduce(lambda s, x: s + x, [x * x for x in _parts(a, b, dim)])
    return _fold(a, b, lambda x: x * x)


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(l2sq(a, b, dim))


def l1(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and dim <= UNROLL:
        return reduce(lambda s, x: s + x, [F.abs(x) for x in _parts(a, b, dim)])
    return _fold(a, b, F.abs)


def linf(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and 2 <= dim <= UNROLL:
        return F.greatest(*[F.abs(x) for x in _parts(a, b, dim)])
    return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))), F.lit(0.0))


def l2sq_by_norms(norm_a: Column, norm_b: Column, dot: Column) -> Column:
    """Squared distance from precomputed squared norms, clamped at 0."""
    return F.greatest(F.lit(0.0), norm_a + norm_b - 2 * dot)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim and dim <= UNROLL:
        return reduce(lambda s, x: s + x, [a[i].cast("double") * b[i].cast("double") for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column, dim: int | None = None) -> Column:
    """Distance by name.  Hamming takes arrays of 32-bit words and is a bit count."""
    kind = resolve(metric)
    if kind == "hamming":
        return hamming_words(a, b, dim)
    return {"l2": l2, "l2sq": l2sq, "l1": l1, "linf": linf}[kind](a, b, dim)
