"""Tail probabilities for small driver-side result tables (one value per column pair or series)."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient on ``n`` pairs."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def _normal_quantile(p: float) -> float:
    """Inverse normal by bisection on erfc; enough for the few order statistics of a tiny sample."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def shapiro_wilk_p(values: list[float]) -> float:
    """Royston's approximation for samples of 8 to 19 values (larger ones use the K-squared test)."""
    x = sorted(values)
    n = len(x)
    m = [_normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm = sum(v * v for v in m)
    u = 1.0 / math.sqrt(n)
    # Royston (1995) polynomial coefficients.
    a_last = -2.706056 * u**5 + 4.434685 * u**4 - 2.071190 * u**3 - 0.147981 * u**2 + 0.221157 * u + m[-1] / math.sqrt(mm)
    a_prev = -3.582633 * u**5 + 5.682633 * u**4 - 1.752461 * u**3 - 0.293762 * u**2 + 0.042981 * u + m[-2] / math.sqrt(mm)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_last**2 - 2 * a_prev**2)
    a = [v / math.sqrt(phi) for v in m]
    a[0], a[1], a[-2], a[-1] = -a_last, -a_prev, a_prev, a_last
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    if ss == 0:
        return 1.0
    w = min(1.0, sum(ai * xi for ai, xi in zip(a, x)) ** 2 / ss)
    if w >= 1.0:
        return 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        stat = -math.log(gamma - math.log(1 - w))
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = math.log(n)
        stat = math.log(1 - w)
        mu = 0.0038915 * ln**3 - 0.083751 * ln**2 - 0.31082 * ln - 1.5861
        sd = math.exp(0.0030302 * ln**2 - 0.082676 * ln - 0.4803)
    return 0.5 * math.erfc((stat - mu) / sd / math.sqrt(2.0))
