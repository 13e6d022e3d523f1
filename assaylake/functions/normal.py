"""Normal distribution functions as Column algebra (Spark has no erf), near double precision.

Published approximations: Hart's rational form for the CDF (1968), Acklam's for the quantile with one
Halley step on top.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# Coefficients, highest power first.
CDF_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT = 7.07106781186547
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0)
PPF_LOW = 0.02425
SQRT_2PI = math.sqrt(2.0 * math.pi)
LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)
TAIL = -6.0


def _horner(coefficients, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def pdf(x: Column) -> Column:
    return F.exp(F.lit(-0.5) * x * x) / F.lit(SQRT_2PI)


def cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(F.lit(-0.5) * a * a)
    inner = e * _horner(CDF_NUM, a) / _horner(CDF_DEN, a)
    fraction = a + F.lit(0.65)
    for numerator in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(numerator) / fraction
    upper = F.when(a < CDF_SPLIT, inner).otherwise(e / fraction / F.lit(SQRT_2PI))
    return F.when(x > 0, F.lit(1.0) - upper).otherwise(upper)


def log_cdf(x: Column) -> Column:
    """log of the CDF; below -6 the two-term Mills expansion, so it never takes log(0)."""
    t = F.least(x, F.lit(TAIL))
    tail = F.lit(-0.5) * t * t - F.lit(LOG_SQRT_2PI) - F.log(-t) + F.log1p(F.lit(-1.0) / (t * t))
    return F.when(x < TAIL, tail).otherwise(F.log(cdf(F.greatest(x, F.lit(TAIL)))))


def ppf(p: Column) -> Column:
    low = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(0.5))))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - F.greatest(p, F.lit(0.5))))
    q = p - F.lit(0.5)
    r = q * q
    start = (F.when(p < PPF_LOW, _horner(PPF_C, low) / _horner(PPF_D, low))
             .when(p > 1.0 - PPF_LOW, -_horner(PPF_C, high) / _horner(PPF_D, high))
             .otherwise(_horner(PPF_A, r) * q / _horner(PPF_B, r)))
    return start


def refine(x: Column, p: Column) -> Column:
    """One Halley step of the quantile `x` towards CDF(x) = p."""
    step = (cdf(x) - p) * F.lit(SQRT_2PI) * F.exp(x * x / F.lit(2.0))
    return x - step / (F.lit(1.0) + x * step / F.lit(2.0))
