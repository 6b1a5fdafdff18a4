"""Tail areas of the t, chi-square and normal distributions for a handful of test statistics.

The inputs are a few numbers per fitted model, so plain Python on the driver is enough.
"""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float) -> float | None:
    """P(|T| >= |t|)."""
    if t is None or math.isnan(t) or df <= 0:
        return None
    return float(beta_inc(df / 2.0, 0.5, df / (df + t * t)))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection of the two-sided tail."""
    target = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while (t_two_sided(high, df) or 0.0) > target:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if (t_two_sided(mid, df) or 0.0) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square_df >= x) by series below the mean and continued fraction above it."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h
