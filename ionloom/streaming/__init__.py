"""Stateless screening of a feature stream.

The method itself is a batch one. Its row filters hold no state, so a streaming frame passes through
them as it is; everything that compares features with each other needs the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ionloom.model import Params
from ionloom.operators import filters


def prefilter(features: DataFrame, params: Params = Params()) -> DataFrame:
    """Time, mass, density and mass-defect filters on a batch or streaming frame."""
    p = params
    kept = filters.rt_range(features, p.rt_min, p.rt_max)
    kept = filters.mz_range(kept, p.mz_min, p.mz_max)
    return filters.mass_defect_range(filters.density_line(kept), p.mass_defect_lo, p.mass_defect_hi)
