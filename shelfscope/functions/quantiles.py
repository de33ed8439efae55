"""Quantiles of Student's t as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom up to which quantiles are computed one by one; above, the expansion
#: around the normal quantile is off by less than 1e-9.
TABLED = 200


def t_tail(t: float, dof: int) -> float:
    """P(T > t) for t >= 0: half the regularised incomplete beta function of dof / (dof + t^2),
    by its continued fraction (modified Lentz)."""
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x >= (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return 0.5 * (1 - _beta(b, a, 1 - x))
    return 0.5 * _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def t_quantile(p: float, dof: int) -> float:
    """The value that T exceeds with probability 1 - p, for 0.5 < p < 1, by bisection."""
    lo, hi = 0.0, 1.0
    while t_tail(hi, dof) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_tail(mid, dof) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def t_column(dof: Column, confidence: float) -> Column:
    """The two-sided quantile for ``confidence`` at a column of degrees of freedom; NULL below 1."""
    p = (1 + confidence) / 2
    z = NormalDist().inv_cdf(p)
    tabled = F.array(*[F.lit(t_quantile(p, v)) for v in range(1, TABLED + 1)])
    v = dof.cast("double")
    series = (F.lit(z) + F.lit((z ** 3 + z) / 4) / v + F.lit((5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96) / (v * v)
              + F.lit((3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384) / (v * v * v)
              + F.lit((79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160) / (v * v * v * v))
    return F.when(dof > TABLED, series).when(dof >= 1, F.try_element_at(tabled, dof.cast("int")))
