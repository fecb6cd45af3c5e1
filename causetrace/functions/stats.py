"""Distribution tails and small linear algebra in NumPy; inputs are per-pair or per-metric, never series of unbounded length."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b)) / a


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) for d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


# MacKinnon (1994, 2010) response surface for the unit-root test with a constant, one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(tau: float) -> float:
    """Approximate p-value of the augmented Dickey-Fuller statistic with a constant."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(TAU_SMALL if tau <= TAU_STAR else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def partial_correlation(corr: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    at = [i, j, *given]
    p = np.linalg.pinv(corr[np.ix_(at, at)])
    return float(np.clip(-p[0, 1] / math.sqrt(abs(p[0, 0] * p[1, 1])), -1, 1))


def fisher_z_p(r: float, n: int, given: int) -> float:
    """Two-sided p-value of a partial correlation by Fisher's transformation."""
    r = min(max(r, -1 + 1e-15), 1 - 1e-15)
    return normal_two_sided(0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - given - 3, 0)))
