"""The isotope plan: report and peak lists to the classified summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ionloom.model import Params
from ionloom.operators import isotope
from ionloom.session import cut_lineage


def isotope_summary(
    features: DataFrame, intensity: DataFrame, peaks: DataFrame, grid: DataFrame | None = None, params: Params = Params(),
    samples: list[str] | None = None,
) -> DataFrame:
    """Per alignment: means, deviations, halogen class and, with a grid, the predicted ratio."""
    p = params
    peaks = cut_lineage(peaks)  # read several times, and costly to make
    anchors = cut_lineage(
        isotope.sample_anchors(features, intensity, peaks, p.isotope_ppm, p.isotope_ccs_pct, p.isotope_rt_tol, by_feature=False)
    )
    rows = isotope.anchors_with_metrics(anchors, isotope.multi_peak_compounds(peaks))
    aligned = cut_lineage(isotope.align(rows, p.isotope_ppm, p.isotope_ccs_pct))
    summary = isotope.halogen_class(isotope.alignment_summary(aligned, samples))
    return summary if grid is None else isotope.grid_ratio(summary, grid)
