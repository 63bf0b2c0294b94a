"""Tail probabilities of a few statistics: scalars worked out once per report row."""

from __future__ import annotations

import math


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by the continued fraction of the incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x >= (a + 1.0) / (a + b + 2.0):
        return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def f_tail(f: float | None, df_between: float, df_within: float) -> float | None:
    """P(F > f) for an F statistic."""
    if f is None or math.isnan(f) or df_between <= 0 or df_within <= 0:
        return None
    if math.isinf(f):
        return 0.0
    return regularized_beta(df_within / (df_within + df_between * f), df_within / 2, df_between / 2)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation coefficient on n pairs."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * (n - 2) / (1.0 - r * r)
    return f_tail(t2, 1, n - 2)


def kolmogorov_p(d: float | None, n: int, m: int) -> float | None:
    """Asymptotic two-sided p of a two-sample Kolmogorov-Smirnov distance."""
    if d is None or n <= 0 or m <= 0:
        return None
    z = d * math.sqrt(n * m / (n + m))
    if z <= 0:
        return 1.0
    if z < 1.18:
        # The theta-function form converges fast where the alternating series does not.
        scale = math.sqrt(2 * math.pi) / z
        below = scale * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in range(1, 20))
        return min(1.0, max(0.0, 1.0 - below))
    tail = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, tail))
