"""Censored-normal (Tobit) row functions, left-censored at `floor`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..registry import FLOOR, FLOOR_TOLERANCE
from . import normal as N


def tobit_nll(f: Column, y: Column, sigma: Column | float, floor: float = FLOOR) -> Column:
    """Negative log-likelihood of one row, without the constant log sqrt(2 pi) of uncensored rows."""
    s = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    z = (y - f) / s
    uncensored = F.lit(0.5) * z * z + F.log(s)
    return F.when(y > floor + FLOOR_TOLERANCE, uncensored).otherwise(-N.log_cdf((F.lit(floor) - f) / s))


def tobit_mean(f: Column, sigma: Column | float, floor: float = FLOOR) -> Column:
    """Expected observed value under the censored model."""
    s = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    a = (f - F.lit(floor)) / s
    return f * N.cdf(a) + s * N.pdf(a) + F.lit(floor) * N.cdf(-a)


def censored_expectation(f: Column, sigma: Column | float, floor: float = FLOOR) -> Column:
    """E[latent | latent <= floor]: fills censored labels in the E-step of a censored fit."""
    s = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    b = (F.lit(floor) - f) / s
    return f - s * F.exp(-F.lit(0.5) * b * b - F.lit(N.LOG_SQRT_2PI) - N.log_cdf(b))
