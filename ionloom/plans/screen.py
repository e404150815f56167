"""The screening plan: from raw intensities to the annotated, cleaned report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ionloom.model import Params
from ionloom.operators import blanks, cleanup, filters, match, regress, report
from ionloom.session import cut_lineage


@dataclass
class Screening:
    report: DataFrame
    intensity: DataFrame
    samples: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, Observation] = field(default_factory=dict)
    members: DataFrame | None = None

    def funnel(self) -> DataFrame:
        """(step, stage, rows) after every stage, as counted while the stages ran."""
        rows = [(i, name, seen.get["rows"]) for i, (name, seen) in enumerate(self.counts.items(), 1)]
        return self.report.sparkSession.createDataFrame(rows, "step int, stage string, rows long")


def combined_filter(rows: DataFrame, level2: DataFrame, ppm: float = 15.0) -> DataFrame:
    """The three chromatographic filters in their order: cross-section prescreen, crowds, unsaturated chains."""
    rows = cut_lineage(match.ccs_prescreen(rows, level2, ppm))
    return filters.drop_unsaturated_chains(cleanup.crowd_elimination(rows))


def screen(
    features: DataFrame,
    intensity: DataFrame,
    level2: DataFrame,
    level5: DataFrame | None = None,
    standards: DataFrame | None = None,
    params: Params = Params(),
) -> Screening:
    """Runs all stages in their fixed order; several depend on what earlier ones left over.

    Lineage is cut where a stage feeds more than one consumer; everything between is one plan.
    """
    p = params
    stages: dict[str, DataFrame] = {}
    counts: dict[str, Observation] = {}

    def seen(name: str, rows: DataFrame) -> DataFrame:
        """`rows`, to be counted by whatever action reads them first."""
        counts[name] = Observation()
        stages[name] = rows.observe(counts[name], F.count(F.lit(1)).alias("rows"))
        return stages[name]

    features = seen("loaded", features)
    intensity = cut_lineage(intensity)
    samples = cut_lineage(intensity.where("role = 'exp'").select("sample").distinct())

    values = blanks.subtract_blanks(intensity, p.blank_method, p.blank_sds)
    values = filters.mask_low_intensity(values, p.min_intensity)
    kept = seen("rt_range", filters.rt_range(features, p.rt_min, p.rt_max))
    kept = cut_lineage(seen("mz_range", filters.mz_range(kept, p.mz_min, p.mz_max).select("feature_id", "mz", "rt", "dt", "ccs")))
    values = cut_lineage(values.join(kept.select("feature_id").hint("merge"), "feature_id", "left_semi"))
    values = cut_lineage(cleanup.smearing(kept, values, p.ccs_pct, p.rt_tol))
    groups = cut_lineage(cleanup.duplicate_groups(kept, p.ppm, p.ccs_pct, p.rt_tol, p.duplicate_cap_ppm))
    kept, values = cleanup.merge_duplicates(kept, values, groups)
    values = cut_lineage(values)
    kept = seen("density_line", filters.density_line(seen("duplicates_merged", kept)))
    kept = seen("mass_defect", filters.mass_defect_range(kept, p.mass_defect_lo, p.mass_defect_hi))
    kept = cut_lineage(seen("detection_frequency", blanks.filter_by_frequency(kept, values, samples, p.frequency_pct)))

    rows = match.annotate(kept, level2, level5, p.ppm, p.ccs_pct, p.rt_tol, p.rt_scoring)
    rows = cut_lineage(seen("annotated", rows))
    if p.remove_standards and standards is not None:
        rows = cut_lineage(seen("standards_removed", match.remove_standards(rows, standards, p.ppm, p.ccs_pct)))
    rows = seen("source_decay", match.remove_source_decay(rows))
    if p.rt_band:
        rows = _band(rows, "rt", regress.rt_band(level2))
    if p.ccs_band:
        rows = _band(rows, "ccs", regress.ccs_band(level2))
    rows = cut_lineage(seen("regression_band", rows))
    rows = cut_lineage(seen("combined_filter", combined_filter(rows, level2, p.ppm)))
    rows = cut_lineage(seen("adducts", cleanup.remove_adducts(rows)))
    rows = seen("neutral_losses", match.remove_neutral_losses(rows))
    rows = rows.join(blanks.detection(values, samples), "feature_id", "left")
    rows = cut_lineage(report.round_report(rows))
    rows = match.remove_halogen_isotopes(rows, p.ppm, p.m2_ccs_fraction, p.rt_tol)
    rows = cut_lineage(seen("halogen_isotopes", rows))
    final = values.join(rows.select("feature_id").hint("merge"), "feature_id", "left_semi")
    return Screening(rows, final, samples, stages, counts, cleanup.duplicate_members(groups))


def _band(rows: DataFrame, value: str, lines: DataFrame) -> DataFrame:
    fitted = [(r.slope, r.intercept) for r in lines.orderBy("q").collect()]
    return filters.regression_band(rows, value, fitted[0], fitted[-1]) if fitted else rows
