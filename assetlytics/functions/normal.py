"""Standard-normal inverse CDF as a pure Column expression (Acklam's
rational approximation, |relative error| < 1.2e-9), so QQ and interval
computations stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of Acklam's approximation.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    p = p.cast("double")
    q_lo = F.sqrt(-2.0 * F.log(p))
    lo = _horner(_C, q_lo) / (_horner(_D, q_lo) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(-2.0 * F.log(F.lit(1.0) - p))
    hi = -_horner(_C, q_hi) / (_horner(_D, q_hi) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + F.lit(1.0))
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
             .when(p < _P_LOW, lo).when(p > 1 - _P_LOW, hi).otherwise(mid))


# Zelen & Severo polynomial for the standard-normal tail
# (Abramowitz & Stegun 26.2.17, |error| < 7.5e-8).
_ZS_P = 0.2316419
_ZS_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def norm_cdf(z: Column) -> Column:
    """Standard-normal CDF as a Column expression."""
    z = z.cast("double")
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_ZS_P) * x)
    poly = t * (F.lit(_ZS_B[0]) + t * (F.lit(_ZS_B[1]) + t * (F.lit(_ZS_B[2]) + t * (F.lit(_ZS_B[3]) + t * F.lit(_ZS_B[4])))))
    tail = F.exp(-(x * x) / F.lit(2.0)) / F.lit(2.5066282746310002) * poly
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
