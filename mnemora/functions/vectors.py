"""Vector expressions over ARRAY columns, evaluated in the JVM in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def phase_alignment(a, b, coupling: float) -> Column:
    """1 for equal phases, 1 - coupling for opposite ones."""
    return F.lit(1 - coupling) + coupling * (0.5 + 0.5 * F.cos(_c(a) - _c(b)))


def quantise_int8(a) -> Column:
    """(scale, codes): symmetric codes in -127..127 with the vector's own scale."""
    v = _c(a).cast("array<double>")
    scale = F.array_max(F.transform(v, F.abs)) / 127.0
    # the scale is taken once for the vector, not once for each value
    return F.element_at(
        F.transform(
            F.array(F.when(scale > 0, scale).otherwise(1.0)),
            lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: F.round(x / s).cast("int")).alias("codes")),
        ),
        1,
    )


def poincare_distance(a, b, radius: float = 0.85) -> Column:
    """Distance in the ball of ``radius``; vectors outside are drawn to just inside it."""
    def inside(x):
        v, n = _c(x).cast("array<double>"), norm(x)
        return F.when(n >= radius, F.transform(v, lambda y: y * (radius * 0.999 / n))).otherwise(v)

    u, v = inside(a), inside(b)
    r2 = radius * radius
    den = F.greatest((r2 - dot(u, u)) * (r2 - dot(v, v)) / r2, F.lit(1e-8))
    return radius * F.acosh(F.greatest(F.lit(1.0), 1 + 2 * squared_distance(u, v) / den))


def circular_mean(phase) -> Column:
    """Aggregate: mean angle in 0..2 pi."""
    p = _c(phase)
    a = F.atan2(F.avg(F.sin(p)), F.avg(F.cos(p)))
    return F.pmod(a, F.lit(6.283185307179586))


def kuramoto_order(phase) -> Column:
    """Aggregate: modulus of the mean unit phase vector, 1 for full synchrony."""
    p = _c(phase)
    return F.hypot(F.avg(F.cos(p)), F.avg(F.sin(p)))
