"""Numeric helpers shared by scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(c: Column, digits: int) -> Column:
    """Round to ``digits`` places exactly as decimal rounding of the stored double (ties to even).

    ``c * 10**digits`` is formed with its rounding error (the factor is split into halves that
    multiply without loss), so a value a hair below a tie is not rounded up.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must lie in 0..7")
    scale = float(10**digits)
    x = c.cast("double")
    product = x * F.lit(scale)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    return F.when(x.isNull() | F.isnan(x), x).otherwise((whole + up.cast("int")) / F.lit(scale))


def ratio(top: Column, bottom: Column, when_zero: float) -> Column:
    """``top / bottom`` as double, with a stated value for an empty denominator."""
    safe = F.when(bottom == 0, F.lit(None)).otherwise(bottom)
    return F.coalesce(top.cast("double") / safe.cast("double"), F.lit(when_zero))
