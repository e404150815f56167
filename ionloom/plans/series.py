"""The homologous-series plan and the trend viewer's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.model import Params
from ionloom.operators import regress, series
from ionloom.session import cut_lineage


def find_series(
    report: DataFrame, library: DataFrame, units: dict[str, float], params: Params = Params(), samples: list[str] = ()
) -> DataFrame:
    """Rows of refined series with group_id, trend, r_squared and the final is_outlier."""
    p = params
    stacked = series.stack_library(report, library, samples)
    groups = series.series_groups(stacked, units, p.ppm, p.series_min_points)
    refined = cut_lineage(series.refine_groups(cut_lineage(groups), p.series_min_points))
    mean = refined.agg(F.avg("ccs")).first()[0]
    outcome = regress.group_trends(
        refined, (mean or 0.0) * p.trend_residual_fraction, p.slope_lo, p.slope_hi, min_inliers=0, min_r2=0.0, trials=p.trend_trials
    )
    return series.validate_trends(cut_lineage(outcome), p.series_min_points, p.series_min_library)


def group_ids(outcome: DataFrame) -> DataFrame:
    return outcome.select("group_id").distinct()


def group_rows(outcome: DataFrame, group_id: int) -> DataFrame:
    return outcome.where(F.col("group_id") == group_id)
