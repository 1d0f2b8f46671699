"""Driver-side scalar distribution functions for p-values of test
statistics that Spark aggregations produce (a handful of scalars per test;
no data passes through here). Pure Python: regularized incomplete gamma and
beta functions by series / continued fractions."""

from __future__ import annotations

import math
from statistics import NormalDist

_EPS = 1e-14
_FPMIN = 1e-300


def _gammainc_lower_reg(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(10000):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * _EPS:
                break
        return s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1.0 - _gammainc_upper_cf(a, x)


def _gammainc_upper_cf(a: float, x: float) -> float:
    b = x + 1 - a
    c = 1 / _FPMIN
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _FPMIN if abs(d) < _FPMIN else d
        c = b + an / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) for X ~ chi-square(df)."""
    if x is None or df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, h = df / 2.0, x / 2.0
    if h < a + 1:
        return 1.0 - _gammainc_lower_reg(a, h)
    return _gammainc_upper_cf(a, h)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = _FPMIN if abs(d) < _FPMIN else d
    d = 1 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = _FPMIN if abs(d) < _FPMIN else d
        c = 1 + aa / c
        c = _FPMIN if abs(c) < _FPMIN else c
        d = 1 / d
        de = d * c
        h *= de
        if abs(de - 1) < _EPS:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_sf_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of a Student t statistic."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def norm_inv_cdf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def ks_pvalue(d: float, n: int) -> float:
    """Asymptotic Kolmogorov distribution tail, P(D_n > d)."""
    if n <= 0 or d is None:
        return float("nan")
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, 200):
        term = 2 * (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-12:
            break
    return min(max(s, 0.0), 1.0)
