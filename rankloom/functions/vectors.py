"""Dense vectors as ARRAY<DOUBLE>, kept in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spread(value: Column, vector) -> Column:
    """The scalar once per element.  A scalar used inside a lambda would be computed again
    for every element; as an array argument it is computed once."""
    return F.array_repeat(value, F.size(_col(vector)))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def centred(a) -> Column:
    mean = F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(_col(a))
    return F.zip_with(_col(a), spread(mean, a), lambda x, m: x.cast("double") - m)


def sq_dist(a, b) -> Column:
    d = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def l2_normalise(a, eps: float = 1e-5) -> Column:
    return F.zip_with(_col(a), spread(norm(a) + F.lit(eps), a), lambda x, n: x.cast("double") / n)


def cosine(a, b, eps: float = 1e-6) -> Column:
    """Dot product over the product of lengths, each length at least eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def cross_layer(x0, xl, weights: list[float], bias: list[float]) -> Column:
    """One cross-network layer: x0 * (xl . w) + b + xl, with literal weights."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    b = F.array(*[F.lit(float(v)) for v in bias])
    scaled = F.zip_with(_col(x0), spread(dot(xl, w), x0), lambda x, s: x.cast("double") * s)
    shifted = F.zip_with(_col(xl), b, lambda x, y: x.cast("double") + y)
    return F.zip_with(scaled, shifted, lambda x, y: x + y)
