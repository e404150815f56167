"""Library matching, and removal of features explained by a library or by another feature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.numeric import half_even, pct_error, ppm_error, ppm_of
from ionloom.model import CLASS_LIKELY, CLASS_TENTATIVE, CLASS_UNMATCHED, NEUTRAL_LOSSES
from ionloom.operators.bands import (
    Band,
    abs_band,
    band_exists_1d,
    band_join,
    band_semi,
    ppm_band,
    ppm_band_of_build,
)
from ionloom.operators.runs import expand_runs, mass_runs, ranked_masses
from ionloom.operators.skew import spread_join
from ionloom.session import cut_lineage


def _pct_band_of_build(point: str, value, pct: float) -> Band:
    """The probe's value within pct percent of the point."""
    f = pct / 100.0
    return Band(point, value / F.lit(1 + f), value / F.lit(1 - f), float(np.log1p(f) - np.log1p(-f)), log=True)


def _within_ppm(x, centre, ppm: float):
    return (x >= centre - ppm_of(centre, ppm)) & (x <= centre + ppm_of(centre, ppm))


def match_level2(
    features: DataFrame, library: DataFrame, ppm: float = 10.0, ccs_pct: float = 2.0, rt_tol: float = 0.5,
    rt_scoring: bool = True,
) -> DataFrame:
    """Every library entry within the mass window of a feature and the tolerances around the entry.

    One row per feature and matching entry: match, match_source, class, mass_error_ppm,
    ccs_error_pct and rt_error. A missing retention time on either side is not held against a pair.
    """
    lib = library.select(
        F.col("lib_id"),
        F.concat("name", F.lit(" ("), "adduct", F.lit(")")).alias("match"),
        F.col("mz").alias("l_mz"),
        F.col("ccs").alias("l_ccs"),
        F.col("rt").alias("l_rt"),
    )
    ccs_error = pct_error(F.col("ccs"), F.col("l_ccs"))
    ok = _within_ppm(F.col("l_mz"), F.col("mz"), ppm) & ccs_error.between(-ccs_pct, ccs_pct)
    rt_error = F.abs(F.col("rt") - F.col("l_rt")) if rt_scoring else F.lit(None).cast("double")
    if rt_scoring:
        ok = ok & F.coalesce(rt_error <= rt_tol, F.lit(True))
    bands = [ppm_band("l_mz", F.col("mz"), ppm), _pct_band_of_build("l_ccs", F.col("ccs"), ccs_pct)]
    pairs = band_join(features, lib, bands, ok)
    return pairs.select(
        *features.columns,
        "match",
        F.lit("CCS Library").alias("match_source"),
        F.lit(CLASS_LIKELY).alias("class"),
        half_even(ppm_error(F.col("mz"), F.col("l_mz")), 2).alias("mass_error_ppm"),
        half_even(ccs_error, 2).alias("ccs_error_pct"),
        half_even(rt_error, 2).alias("rt_error"),
    )


def unmatched(features: DataFrame, matched: DataFrame) -> DataFrame:
    rest = features.join(matched.select("feature_id"), "feature_id", "left_anti")
    return rest.select(
        *features.columns,
        F.lit("No Match").alias("match"),
        F.lit("None").alias("match_source"),
        F.lit(CLASS_UNMATCHED).alias("class"),
        *[F.lit(None).cast("double").alias(c) for c in ("mass_error_ppm", "ccs_error_pct", "rt_error")],
    )


def suspects_by_mass(features: DataFrame, suspects: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Per distinct feature mass: all suspect names within the window joined, and the distinct errors.

    A suspect list holds no other coordinate, so the answer depends on the mass alone: each mass is
    looked up once however many features share it, and equal suspects are merged beforehand.
    """
    masses = features.select("mz").distinct()
    lib = suspects.where("mz IS NOT NULL").select(F.col("name"), F.col("mz").alias("l_mz")).distinct()
    ok = _within_ppm(F.col("l_mz"), F.col("mz"), ppm)
    pairs = band_join(masses, lib, [ppm_band("l_mz", F.col("mz"), ppm)], ok)
    error = half_even(ppm_error(F.col("mz"), F.col("l_mz")), 2) + F.lit(0.0)
    return pairs.groupBy("mz").agg(
        F.array_join(F.array_sort(F.collect_set("name")), " or ").alias("match"),
        F.array_sort(F.collect_set(error)).alias("mass_errors_ppm"),
    )


def match_level5(features: DataFrame, suspects: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Features with suspects in their mass window, one row each, class `tentative`."""
    found = suspects_by_mass(features, suspects, ppm)
    return spread_join(features, found, ["mz"]).select(
        *features.columns,
        "match",
        F.lit("Suspects Library").alias("match_source"),
        F.lit(CLASS_TENTATIVE).alias("class"),
        "mass_errors_ppm",
    )


def annotate(
    features: DataFrame, level2: DataFrame, level5: DataFrame | None, ppm: float, ccs_pct: float, rt_tol: float, rt_scoring: bool
) -> DataFrame:
    """Level-2 rows, then suspects for the rest, then what is left; one column layout."""
    likely = match_level2(features, level2, ppm, ccs_pct, rt_tol, rt_scoring)
    rest = unmatched(features, likely)
    if level5 is None:
        return likely.unionByName(rest, allowMissingColumns=True).withColumn("mass_errors_ppm", F.lit(None).cast("array<double>"))
    found = suspects_by_mass(rest, level5, ppm).withColumnRenamed("match", "_match")
    tentative = F.col("_match").isNotNull()
    rest = spread_join(rest, found, ["mz"], "left").select(
        *features.columns,
        F.coalesce("_match", "match").alias("match"),
        F.when(tentative, "Suspects Library").otherwise(F.col("match_source")).alias("match_source"),
        F.when(tentative, CLASS_TENTATIVE).otherwise(F.col("class")).alias("class"),
        "mass_error_ppm", "ccs_error_pct", "rt_error", "mass_errors_ppm",
    )
    return likely.unionByName(rest, allowMissingColumns=True)


def remove_standards(report: DataFrame, standards: DataFrame, ppm: float, ccs_pct: float) -> DataFrame:
    """Drops unmatched and tentative features on a standard, or on its M-1 artefact."""
    offset = F.explode(F.array(F.lit(0.0), F.lit(-1.0)))
    std = (
        standards.where("mz IS NOT NULL AND ccs IS NOT NULL")
        .select(F.col("mz").alias("s_mz"), F.col("ccs").alias("s_ccs"), offset.alias("s_off"))
        .withColumn("s_target", F.col("s_mz") + F.col("s_off"))
    )
    tol = ppm_of("s_mz", ppm)
    spread = F.col("s_ccs") * F.lit(float(ccs_pct)) / F.lit(100.0)
    ok = F.col("mz").between(F.col("s_target") - tol, F.col("s_target") + tol) & F.col("ccs").between(
        F.col("s_ccs") - spread, F.col("s_ccs") + spread
    )
    # The window is relative to the standard, so seen from the feature the offset shifts it a little.
    f = ppm * 1e-6
    shift = F.col("s_off") * F.lit(f)
    mass = Band(
        "s_target", (F.col("mz") + shift) / F.lit(1 + f), (F.col("mz") - shift) / F.lit(1 - f),
        float(np.log1p(f) - np.log1p(-f)), log=True,
    )
    candidates = report.where(F.col("class").isin(CLASS_UNMATCHED, CLASS_TENTATIVE)).select("feature_id", "mz", "ccs")
    bands = [mass, _pct_band_of_build("s_ccs", F.col("ccs"), ccs_pct)]
    hits = band_semi(
        candidates.withColumn("s_off", F.explode(F.array(F.lit(0.0), F.lit(-1.0)))), std, bands, ok, ["feature_id"], on=("s_off",)
    )
    removable = F.col("class").isin(CLASS_UNMATCHED, CLASS_TENTATIVE)
    kept = report.where(~removable)
    return kept.unionByName(report.where(removable).join(hits, "feature_id", "left_anti"))


def remove_source_decay(report: DataFrame, ppm: float = 10.0, rt_tol: float = 1.0, factor: float = 1.03) -> DataFrame:
    """Drops features that sit on a likely one in mass and time with a cross-section 3 % above it."""
    likely = report.where(F.col("class") == CLASS_LIKELY).select(
        F.col("mz").alias("p_mz"), F.col("rt").alias("p_rt"), F.col("ccs").alias("p_ccs")
    ).distinct()
    others = report.where(F.col("class") != CLASS_LIKELY).select("feature_id", "mz", "rt", "ccs")
    ok = (
        _within_ppm(F.col("mz"), F.col("p_mz"), ppm)
        & (F.abs(F.col("p_rt") - F.col("rt")) < rt_tol)
        & (F.col("ccs") >= F.col("p_ccs") * F.lit(factor))
    )
    bands = [ppm_band_of_build("p_mz", F.col("mz"), ppm), abs_band("p_rt", F.col("rt"), rt_tol)]
    hits = band_semi(others, likely, bands, ok, ["feature_id"], prefer={"p_ccs": "low"})
    return report.join(hits, "feature_id", "left_anti")


def ccs_prescreen(report: DataFrame, library: DataFrame, ppm: float = 15.0, factor: float = 1.03) -> DataFrame:
    """Drops non-likely features with library neighbours in mass, all of them clearly smaller.

    'Above 1.03 times the largest neighbour' is 'has a neighbour, and none whose limit reaches it',
    which needs two existence tests and no grouping of neighbours.
    """
    lib = library.select(F.col("mz").alias("l_mz"), F.col("ccs").alias("l_ccs")).distinct()
    others = report.where(F.col("class") != CLASS_LIKELY).select("feature_id", "mz", "ccs")
    near = _within_ppm(F.col("l_mz"), F.col("mz"), ppm)
    band = [ppm_band("l_mz", F.col("mz"), ppm)]
    reached = F.col("ccs") <= F.lit(factor) * F.col("l_ccs")
    with_neighbour = band_semi(others, lib, band, near & F.col("ccs").isNotNull(), ["feature_id"])
    fine = band_semi(others, lib, band, near & reached, ["feature_id"], prefer={"l_ccs": "high"})
    drop = with_neighbour.join(fine, "feature_id", "left_anti")
    return report.join(drop, "feature_id", "left_anti")


def _loss_targets(masses: DataFrame) -> DataFrame:
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(mass).alias("loss")) for label, mass in NEUTRAL_LOSSES])
    return (
        masses.select(F.col("mz").alias("mz1"), F.explode(table).alias("l"))
        .select("mz1", "l.label", (F.col("mz1") - F.col("l.loss")).alias("target"))
        .where("target > 0")
    )


def neutral_loss_runs(features: DataFrame, ppm: float = 15.0) -> DataFrame:
    """(mz1, label, first_rank, last_rank): which distinct masses are mz1 less a neutral loss, as ranks of `ranked_masses`."""
    masses = cut_lineage(features.select("mz").where("mz IS NOT NULL").distinct())
    return mass_runs(_loss_targets(masses), masses, ppm)


def neutral_loss_pairs(features: DataFrame, ppm: float = 15.0) -> DataFrame:
    """Pairs of distinct masses that differ by a neutral loss: mz1, mz2, delta, label."""
    pairs = expand_runs(neutral_loss_runs(features, ppm), ranked_masses(features))
    return pairs.select("mz1", "mz2", (F.col("mz1") - F.col("mz2")).alias("delta"), "label")


def remove_neutral_losses(report: DataFrame, ppm: float = 15.0) -> DataFrame:
    """Drops masses that are a heavier mass less a neutral loss, unless their first row is likely."""
    order = F.struct(F.col("feature_id"))
    masses = report.where("mz IS NOT NULL").groupBy("mz").agg(F.min_by("class", order).alias("first_class"))
    targets = _loss_targets(masses)
    window = ppm_of("target", ppm)
    hits = band_exists_1d(
        masses.where(F.col("first_class") != CLASS_LIKELY).select("mz"),
        targets,
        ppm_band_of_build("target", F.col("mz"), ppm),
        F.col("target") - window,
        F.col("target") + window,
        F.col("mz"),
    )
    return spread_join(report, hits.where("hit").select("mz"), ["mz"], "left_anti")


def remove_halogen_isotopes(
    report: DataFrame, ppm: float, ccs_fraction: float, rt_tol: float, order_result: bool = True
) -> DataFrame:
    """Drops M+2 and M+4 partners of another feature; sorted by class rank, then mass.

    Cross-sections agree when they differ by at most `ccs_fraction` of the larger one.
    """
    offset = F.explode(F.array(F.lit(2.0), F.lit(4.0)))
    base = report.select(
        F.col("mz").alias("i_mz"), F.col("rt").alias("i_rt"), F.col("ccs").alias("i_ccs")
    ).distinct().select("*", offset.alias("off")).withColumn("i_target", F.col("i_mz") + F.col("off"))
    probe = report.select("feature_id", "mz", "rt", "ccs").withColumn("off", F.explode(F.array(F.lit(2.0), F.lit(4.0))))
    tol = ppm_of("i_mz", ppm)
    ok = (
        F.col("mz").between(F.col("i_target") - tol, F.col("i_target") + tol)
        & (F.abs(F.col("i_ccs") - F.col("ccs")) <= F.greatest(F.col("i_ccs") * F.lit(ccs_fraction), F.col("ccs") * F.lit(ccs_fraction)))
        & (F.abs(F.col("i_rt") - F.col("rt")) <= rt_tol)
    )
    f = ppm * 1e-6
    shift = F.col("off") * F.lit(f)
    mass = Band(
        "i_target", (F.col("mz") + shift) / F.lit(1 + f), (F.col("mz") - shift) / F.lit(1 - f),
        float(np.log1p(f) - np.log1p(-f)) * 0.9, log=True,
    )
    bands = [mass, abs_band("i_rt", F.col("rt"), rt_tol)]
    if ccs_fraction < 1:
        bands.append(
            Band("i_ccs", F.col("ccs") * F.lit(1 - ccs_fraction), F.col("ccs") / F.lit(1 - ccs_fraction),
                 float(-2 * np.log1p(-ccs_fraction)), log=True)
        )
        hits = band_semi(probe, base, bands, ok, ["feature_id"], on=("off",))
    else:
        # |a - b| <= f * max(a, b) holds for any two positive values once f >= 1.
        hits = band_semi(probe.where("ccs > 0"), base.where("i_ccs > 0").drop("i_ccs").withColumn("i_ccs", F.lit(1.0)).distinct(),
                         bands, _without_ccs(tol, rt_tol), ["feature_id"], on=("off",))
    kept = report.join(hits, "feature_id", "left_anti")
    if not order_result:
        return kept
    return kept.orderBy(class_rank(), "mz", "feature_id")


def _without_ccs(tol, rt_tol: float):
    return F.col("mz").between(F.col("i_target") - tol, F.col("i_target") + tol) & (
        F.abs(F.col("i_rt") - F.col("rt")) <= rt_tol
    )


def class_rank():
    c = F.col("class")
    return F.when(c == CLASS_LIKELY, 0).when(c == CLASS_TENTATIVE, 1).when(c == CLASS_UNMATCHED, 2).otherwise(3)
