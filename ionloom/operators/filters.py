"""Row filters on features and masks on intensities. All stateless, so they also take streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.numeric import mass_defect, ppm_of
from ionloom.model import MASS_C, MASS_F


def mask_low_intensity(intensity: DataFrame, minimum: float = 100.0) -> DataFrame:
    """Values under the minimum become 0; missing ones stay missing, no row goes."""
    return intensity.withColumn("value", F.when(F.col("value") < minimum, 0.0).otherwise(F.col("value")))


def rt_range(features: DataFrame, lo: float, hi: float) -> DataFrame:
    return features.where(F.col("rt").between(lo, hi))


def mz_range(features: DataFrame, lo: float, hi: float) -> DataFrame:
    return features.where(F.col("mz").between(lo, hi))


def mass_defect_range(features: DataFrame, lo: float, hi: float) -> DataFrame:
    return features.where(mass_defect().between(lo, hi))


def density_line(features: DataFrame) -> DataFrame:
    """Keeps fluorine-dense features: cross-section under the line 0.19 * m/z + 110.28."""
    return features.where(F.col("mz") * F.lit(0.19) + F.lit(110.28) > F.col("ccs"))


def drop_unsaturated_chains(features: DataFrame, ppm: float = 50.0, max_carbons: int = 39) -> DataFrame:
    """Drops CnF(2n-1) masses, n = 1..max_carbons, found in closed form from the nearest n."""
    n = F.rint((F.col("mz") + F.lit(MASS_F)) / F.lit(MASS_C + 2 * MASS_F))
    formula = F.lit(MASS_C) * n + F.lit(MASS_F) * (F.lit(2.0) * n - F.lit(1.0))
    tol = ppm_of(formula, ppm)
    hit = n.between(1, max_carbons) & (F.col("mz") >= formula - tol) & (F.col("mz") <= formula + tol)
    return features.where(~F.coalesce(hit, F.lit(False)))


def regression_band(
    features: DataFrame, value: str, low: tuple[float, float], high: tuple[float, float]
) -> DataFrame:
    """Keeps rows with low(ln m/z) <= value <= high(ln m/z); each line is (slope, intercept)."""
    x = F.ln("mz")
    above = F.col(value) >= F.lit(low[0]) * x + F.lit(low[1])
    below = F.col(value) <= F.lit(high[0]) * x + F.lit(high[1])
    return features.where(above & below)
