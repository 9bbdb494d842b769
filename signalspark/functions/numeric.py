"""Rounding, validity and safe arithmetic."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, digits: int = 5) -> Column:
    """Half-even rounding of the scaled double."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def div(a: Column, b: Column) -> Column:
    """a / b as double; null for a zero divisor."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def div0(a: Column, b: Column) -> Column:
    """a / b as double; 0 for a zero divisor."""
    return F.coalesce(div(a, b), F.lit(0.0))


def valid(*cs: Column) -> Column:
    """All are neither null nor NaN."""
    out = F.lit(True)
    for c in cs:
        out = out & c.isNotNull() & ~F.isnan(c)
    return F.coalesce(out, F.lit(False))


def round_significant(c: Column, digits: int) -> Column:
    """Rounding to significant digits; 0 stays 0."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), places)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def to_number(c: Column, digits: int = 3) -> Column:
    """Text to a rounded double; null where it isn't a number."""
    return rnd(c.try_cast("double"), digits)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
