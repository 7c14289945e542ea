"""Tail probabilities as column expressions: t, F, chi-square and normal.

Each is a ratio of two integrals of the density over the logarithm of the statistic, where
it has one peak and tails that fall exponentially, by double-exponential quadrature on a
finite interval. The nodes are an array literal; everything stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP, _REACH = 0.04, 3.2


def _nodes() -> list[tuple[float, float]]:
    """(place, weight) on -1..1 of the tanh-sinh rule."""
    out = []
    for i in range(-int(_REACH / _STEP), int(_REACH / _STEP) + 1):
        t = i * _STEP
        inner = math.pi / 2 * math.sinh(t)
        out.append((math.tanh(inner), _STEP * math.pi / 2 * math.cosh(t) / math.cosh(inner) ** 2))
    return out


def _integral(log_density, low: Column, high: Column) -> Column:
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _nodes()])
    mid, half = (low + high) / 2.0, (high - low) / 2.0
    total = F.aggregate(nodes, F.lit(0.0), lambda a, n: a + n["w"] * F.exp(log_density(mid + half * n["x"])))
    return F.when(high > low, total * half).otherwise(0.0)


def _upper(log_density, statistic: Column, sd: Column, left: Column, right: Column) -> Column:
    """Share of the density (over the log of the statistic, peak at 0) above ``statistic``, clipped to 0..1.

    The peak and the tails of length ``left`` and ``right`` beside it are integrated on their own.
    """
    at = F.ln(statistic)
    cuts = [-6.0 * sd - left, -6.0 * sd, 6.0 * sd, 6.0 * sd + right]
    parts = list(zip(cuts, cuts[1:]))
    above = sum(_integral(log_density, F.greatest(at, low), high) for low, high in parts)
    p = above / sum(_integral(log_density, low, high) for low, high in parts)
    return (F.when(statistic.isNull() | F.isnan(statistic), None).when(statistic <= 0, 1.0)
            .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def p_f(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """P(F(df1, df2) > f)."""
    f, a, b = _col(f), _col(df1), _col(df2)
    sd = F.sqrt(2.0 / a + 2.0 / b)

    def log_density(v: Column) -> Column:
        return a / 2.0 * v - (a + b) / 2.0 * (F.log1p(a / b * F.exp(v)) - F.log1p(a / b))

    return _upper(log_density, f, sd, 80.0 / a, 80.0 / b)


def p_t(t: Column | str, df: Column | str) -> Column:
    """Two-sided P(|T(df)| > |t|): the square of T is F(1, df)."""
    t = _col(t)
    return p_f(t * t, F.lit(1.0), df)


def p_chi2(x: Column | str, df: Column | str) -> Column:
    """P(chi-square(df) > x)."""
    x, k = _col(x), _col(df)
    sd = F.sqrt(2.0 / k)

    def log_density(v: Column) -> Column:
        # v is the log of x / df
        return k / 2.0 * (v - F.exp(v) + 1.0)

    return _upper(log_density, x / k, sd, 80.0 / k, F.lit(1.0))


def p_normal(z: Column | str) -> Column:
    """Two-sided P(|Z| > |z|): the square of Z is chi-square with one degree of freedom."""
    z = _col(z)
    return p_chi2(z * z, F.lit(1.0))
