"""Distribution functions that the kernels need, from published series."""

from __future__ import annotations

import math


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d = 1.0 / ((1.0 + num * d) or tiny)
        c = (1.0 + num / c) or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def student_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return 1.0 if t == 0 else incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
