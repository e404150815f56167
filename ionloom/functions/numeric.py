"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """NaN becomes NULL, so comparisons are false and aggregates skip it."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def half_even(c: str | Column, places: int = 0) -> Column:
    """Round half to even the binary way: scale, round to the nearest integer, scale back."""
    c = col(c)
    if places == 0:
        return F.rint(c)
    return F.rint(c * F.lit(float(10**places))) / F.lit(float(10**places))


def ppm_of(mass: str | Column, ppm: float, charge: str | Column | None = None) -> Column:
    """Absolute mass error of a relative one; divided by the charge when there is one."""
    error = col(mass) * F.lit(float(ppm)) * F.lit(1e-6)
    return error if charge is None else error / col(charge)


def ppm_error(measured: Column, expected: Column) -> Column:
    return (measured - expected) / expected * F.lit(1e6)


def pct_error(measured: Column, expected: Column) -> Column:
    return (measured - expected) / expected * F.lit(100.0)


def mass_defect(mz: str | Column = "mz") -> Column:
    return col(mz) - F.rint(col(mz))


def kendrick_defect(mz: str | Column, factor: float) -> Column:
    scaled = col(mz) * F.lit(float(factor))
    return F.rint(scaled) - scaled


def to_double(c: str | Column) -> Column:
    """Text or number to DOUBLE; anything unreadable, and NaN, becomes NULL."""
    return no_nan(col(c).try_cast("double"))


def shorten(c: str | Column, limit: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def pinball(actual: Column, predicted: Column, q: float | Column) -> Column:
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    delta = actual - predicted
    return F.greatest(q * delta, (q - F.lit(1.0)) * delta)
