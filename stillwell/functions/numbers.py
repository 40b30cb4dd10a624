"""Numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .constants import QUANTUM


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_log_inverse(u: Column) -> Column:
    return F.signum(u) * F.expm1(F.abs(u))


def clip(x: Column, low: float, high: float) -> Column:
    """Limited to ``low..high``; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def ratio_or_null(x: Column, y: Column) -> Column:
    """``x / y``, null where ``y`` is zero or null."""
    return x / F.nullif(y, F.lit(0.0))


def ratio_at_least_one(x: Column, n: Column) -> Column:
    return x / F.greatest(n, F.lit(1))


def year_angle(day_of_year: Column) -> Column:
    return (day_of_year - 1) * F.lit(2 * math.pi / 365.25)


def quantise(mm: Column) -> Column:
    """One-byte log code of a daily amount; missing or negative counts as dry."""
    code = F.rint(F.log1p(F.greatest(F.coalesce(mm, F.lit(0.0)), F.lit(0.0))) * QUANTUM)
    return clip(code, 0.0, 255.0).cast("short")


def dequantise(code: Column) -> Column:
    return F.expm1(code / F.lit(QUANTUM))


def tenths(mm: Column) -> Column:
    """Amount in tenths, clipped to 0..3000 and rounded half to even; null and NaN stay missing."""
    known = F.when(F.isnan(mm), None).otherwise(mm)
    return F.bround(clip(known, 0.0, 3000.0) * 10, 0).cast("short")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate, over rows where both are known; null where either does not vary.

    The built-in raises on a constant column in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
