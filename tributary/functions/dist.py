"""Upper tails of the F, chi-squared and normal distributions, from continued fractions and series; no SciPy."""

from __future__ import annotations

import math

TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or TINY)
            c = 1 + k / c or TINY
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def f_sf(x: float, d1: float, d2: float) -> float:
    """P(F >= x) with (d1, d2) degrees of freedom; NaN where that isn't defined."""
    if not (math.isfinite(x) and d1 > 0 and d2 > 0):
        return math.nan
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def chi2_sf(x: float, df: float) -> float:
    """P(chi-squared >= x); negative x counts as 0."""
    if not (math.isfinite(x) and df > 0):
        return math.nan
    x = max(x, 0.0)
    return gamma_q(df / 2, x / 2)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or TINY)
        c = b + k / c or TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
