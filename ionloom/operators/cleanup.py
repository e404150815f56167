"""Artefact removal and grouping: smearing, adducts, duplicates, crowds, isotope chains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.numeric import ppm_of
from ionloom.model import ADDUCT_RULES, CLASS_LIKELY, CLASS_TENTATIVE, CLASS_UNMATCHED
from ionloom.operators.bands import (
    Band,
    abs_band,
    band_exists_1d,
    band_semi,
    ppm_band_of_build,
    tiling,
)
from ionloom.operators.components import box_components
from ionloom.operators.ordered import anchored_windows, with_previous, with_running_sum
from ionloom.operators.runs import expand_runs, mass_runs, ranked_masses
from ionloom.operators.skew import spread_join
from ionloom.session import cut_and_count, cut_lineage

SMEAR_FACTOR = 50.0


def smearing(
    features: DataFrame, intensity: DataFrame, ccs_pct: float = 2.0, rt_tol: float = 0.5, mz_back: float = 2.0,
    hot_cell: int | None = None,
) -> DataFrame:
    """Intensities with the detector's smear set to 0.

    A value is smear when, in the same sample, a feature before it in (m/z, feature_id) order, at
    most `mz_back` Da lower and close in time and cross-section, still has more than 50 times its
    intensity. 'Still' makes the rule order-dependent: a value that was zeroed no longer counts.

    A value can only fall to one at least 50 times as large, hence from a higher intensity decade of
    base 50. Going through these decades from the top, everything that could act on a decade has
    been settled before, so a handful of existence joins reproduces the sequential walk.
    """
    coordinates = features.select("feature_id", "mz", "rt", "ccs").where("mz IS NOT NULL AND rt IS NOT NULL AND ccs > 0")
    ends = intensity.where("value > 0").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    # Each border is the product that the rule compares with, so rounding cannot put both sides into one decade.
    borders = [ends["lo"]] if ends["lo"] is not None else []
    while borders and borders[-1] * SMEAR_FACTOR <= ends["hi"]:
        borders.append(borders[-1] * SMEAR_FACTOR)
    level = sum((F.when(F.col("value") >= F.lit(b), 1).otherwise(0) for b in borders), F.lit(0))
    rows = cut_lineage(
        intensity.where("value > 0").join(coordinates.hint("merge"), "feature_id").select(
            "feature_id", "sample", "value", "mz", "rt", "ccs", level.alias("level")
        )
    )
    levels = [r[0] for r in rows.select("level").distinct().orderBy(F.desc("level")).collect()]
    f = ccs_pct / 100.0
    ok = (
        ((F.col("j_mz") < F.col("mz")) | ((F.col("j_mz") == F.col("mz")) & (F.col("j_id") < F.col("feature_id"))))
        & (F.col("j_mz") >= F.col("mz") - F.lit(mz_back))
        & (F.abs(F.col("j_ccs") - F.col("ccs")) / F.col("ccs") * F.lit(100.0) < F.lit(float(ccs_pct)))
        & (F.abs(F.col("j_rt") - F.col("rt")) <= F.lit(rt_tol))
        & (F.col("j_value") > F.lit(SMEAR_FACTOR) * F.col("value"))
    )
    bands = [
        Band("j_mz", F.col("mz") - F.lit(mz_back), F.col("mz"), mz_back, tie="j_id"),
        Band("j_ccs", F.col("ccs") * F.lit(1 - f), F.col("ccs") * F.lit(1 + f), float(np.log1p(f) - np.log1p(-f)), log=True),
        abs_band("j_rt", F.col("rt"), rt_tol),
    ]
    # The rows of a level are a part of all rows: tiles that suit all of them suit each level.
    everywhere = rows.select("sample", F.col("mz").alias("j_mz"), F.col("ccs").alias("j_ccs"), F.col("rt").alias("j_rt"))
    tiles = tiling(everywhere, bands, ("sample",), hot_cell)
    settled = None
    smeared = None
    for value in levels:
        current = rows.where(F.col("level") == value)
        if settled is not None:
            strong = settled.select(
                "sample", F.col("mz").alias("j_mz"), F.col("ccs").alias("j_ccs"), F.col("rt").alias("j_rt"),
                F.col("feature_id").alias("j_id"), F.col("value").alias("j_value"),
            )
            hits = band_semi(
                current, strong, bands, ok, ["feature_id", "sample"], on=("sample",), prefer={"j_value": "high"},
                hot_cell=hot_cell, tiles=tiles,
            )
            hits = cut_lineage(hits.distinct())
            smeared = hits if smeared is None else smeared.unionByName(hits)
            current = cut_lineage(current.join(hits, ["feature_id", "sample"], "left_anti"))
        settled = current if settled is None else settled.unionByName(current)
    if smeared is None:
        return intensity
    flags = smeared.withColumn("_smear", F.lit(True))
    return intensity.join(flags, ["feature_id", "sample"], "left").withColumn(
        "value", F.when(F.col("_smear"), 0.0).otherwise(F.col("value"))
    ).drop("_smear")


def _adduct_targets(masses: DataFrame) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in ADDUCT_RULES])
    return masses.select(F.col("mz").alias("mz1"), F.explode(rules).alias("r")).select(
        "mz1", "r.label", (F.col("r.a") * F.col("mz1") + F.col("r.b")).alias("target")
    )


def adduct_status(features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """(mz, matched): which distinct masses are an adduct or multimer of a lower mass.

    Masses count in ascending order; one that was matched itself raises no targets. Per round a mass
    is settled as matched when a settled, unmatched mass targets it, and as unmatched when no mass
    that targets it is open any more. Both are existence tests against per-cell extremes of the
    targets, so no pairs are formed.
    """
    open_masses, left = cut_and_count(features.select("mz").where("mz IS NOT NULL").distinct())
    free = matched = None
    band = ppm_band_of_build("target", F.col("mz"), ppm)
    window = ppm_of("target", ppm)
    while left:
        sources = open_masses.select("mz", F.lit(True).alias("is_open"))
        if free is not None:
            sources = sources.unionByName(free.select("mz", F.lit(False).alias("is_open")))
        targets = _adduct_targets(sources).join(sources.withColumnRenamed("mz", "mz1"), "mz1")
        seen = band_exists_1d(
            open_masses, targets, band, F.col("target") - window, F.col("target") + window, F.col("mz"),
            build_flags={"by_free": ~F.col("is_open"), "by_open": F.col("is_open")}, total=4 * left,
        )
        seen, left = cut_and_count(seen, "NOT by_free AND by_open")
        hit = seen.where("by_free").select("mz")
        quiet = seen.where("NOT by_free AND NOT by_open").select("mz")
        matched = hit if matched is None else matched.unionByName(hit)
        free = quiet if free is None else free.unionByName(quiet)
        open_masses = seen.where("NOT by_free AND by_open").select("mz")
    if matched is None:
        return open_masses.withColumn("matched", F.lit(False))
    return matched.withColumn("matched", F.lit(True)).unionByName(free.withColumn("matched", F.lit(False)))


def adduct_runs(features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """(mz1, label, first_rank, last_rank): the masses that each unmatched one has as adducts, as ranks of `ranked_masses`."""
    status = cut_lineage(adduct_status(features, ppm))
    return mass_runs(_adduct_targets(status.where("NOT matched").select("mz")), status.select("mz"), ppm)


def adduct_pairs(features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Mass pairs the walk records: mz1 (unmatched), mz2, delta and the rule's label."""
    pairs = expand_runs(adduct_runs(features, ppm), ranked_masses(features))
    return pairs.select("mz1", "mz2", (F.col("mz2") - F.col("mz1")).alias("delta"), "label")


def remove_adducts(report: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Drops unmatched and tentative rows at a mass that is an adduct of a lower one."""
    matched = adduct_status(report, ppm).where("matched").select("mz")
    removable = F.col("class").isin(CLASS_UNMATCHED, CLASS_TENTATIVE)
    return report.where(~removable).unionByName(spread_join(report.where(removable), matched, ["mz"], "left_anti"))


def duplicate_groups(
    features: DataFrame, ppm: float, ccs_pct: float, rt_tol: float, cap_ppm: float = 20.0, hot_cell: int | None = None
) -> DataFrame:
    """(feature_id, component) of the features that have a duplicate; component is the lowest id.

    Two features are duplicates when they agree in mass (within the larger of their ppm tolerances,
    and within `cap_ppm` of the lower one), cross-section (percent of the larger) and time. On the
    scales ln m/z, ln CCS and RT this is a box of fixed size around each feature, so all features in
    a grid cell no larger than the box are duplicates of each other. Cells therefore become one node
    each, and only need to be linked where a feature of one cell has a partner in the next one.
    """
    m = min(-np.log1p(-ppm * 1e-6), np.log1p(cap_ppm * 1e-6))
    c = -np.log1p(-ccs_pct / 100.0)
    bands = [
        Band("q_mz", F.col("mz") * F.lit(float(np.exp(-m))), F.col("mz") * F.lit(float(np.exp(m))), float(m), log=True),
        Band("q_ccs", F.col("ccs") * F.lit(float(np.exp(-c))), F.col("ccs") * F.lit(float(np.exp(c))), float(c), log=True),
        Band("q_rt", F.col("rt") - F.lit(rt_tol), F.col("rt") + F.lit(rt_tol), rt_tol),
    ]
    low, high = F.least("mz", "q_mz"), F.greatest("mz", "q_mz")
    ok = (
        (high - low <= ppm_of(high, ppm))
        & (high - low <= low * F.lit(cap_ppm * 1e-6))
        & (F.abs(F.col("ccs") - F.col("q_ccs")) <= F.greatest("ccs", "q_ccs") * F.lit(float(ccs_pct)) / F.lit(100.0))
        & (F.abs(F.col("rt") - F.col("q_rt")) <= rt_tol)
    )
    rows = features.where("mz > 0 AND ccs > 0 AND rt IS NOT NULL").select("feature_id", "mz", "ccs", "rt")
    found = box_components(rows, "feature_id", ["mz", "ccs", "rt"], [(bands, ok)], hot_cell=hot_cell)
    return found.where("size > 1").select("feature_id", "component")


def merge_duplicates(features: DataFrame, intensity: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One feature per duplicate group: mean coordinates, highest id, highest intensity per sample.

    Returns features (with the number of those they stand for) and intensities keyed by the kept id;
    `duplicate_members` lists which feature went where.
    """
    keyed = features.join(groups, "feature_id", "left")
    single = keyed.where("component IS NULL").select("feature_id", "mz", "rt", "dt", "ccs", F.lit(1).cast("long").alias("members"))
    merged = (
        keyed.where("component IS NOT NULL")
        .groupBy("component")
        .agg(
            F.max("feature_id").alias("feature_id"),
            *[F.avg(c).alias(c) for c in ("mz", "rt", "dt", "ccs")],
            F.count(F.lit(1)).alias("members"),
        )
    )
    kept = single.unionByName(merged.drop("component"))
    moved = (
        intensity.join(duplicate_members(groups), "feature_id", "left")
        .groupBy(F.coalesce("kept_id", "feature_id").alias("feature_id"), "sample")
        .agg(F.max("value").alias("value"))
    )
    return kept, moved


def duplicate_members(groups: DataFrame) -> DataFrame:
    """(feature_id, kept_id) of the features that are merged, the kept one included."""
    kept = groups.groupBy("component").agg(F.max("feature_id").alias("kept_id"))
    return spread_join(groups, kept, ["component"]).select("feature_id", "kept_id")


def merge_metadata(features: DataFrame, members: DataFrame) -> DataFrame:
    """(feature_id, meta) after merging: `features` has feature_id, mz and the map `meta`, `members` (feature_id, kept_id).

    Of a merged group, a key whose values are all numbers takes the largest; any other the first text by m/z.
    """
    rows = features.select("feature_id", "mz", F.explode_outer("meta").alias("key", "value"))
    rows = spread_join(rows, members, ["feature_id"], "left").withColumn("kept", F.coalesce("kept_id", "feature_id"))
    number = F.expr("try_cast(value AS DOUBLE)")
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct("mz", "feature_id")))
    largest = F.max_by("value", number)
    numeric = F.count(number) == F.count("value")
    merged = rows.groupBy("kept", "key").agg(F.when(numeric, largest).otherwise(first).alias("value"))
    entries = F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))
    return merged.groupBy(F.col("kept").alias("feature_id")).agg(F.map_from_entries(entries).alias("meta"))


def crowd_elimination(report: DataFrame, ppm: float = 50.0, crowd: int = 3) -> DataFrame:
    """Drops non-likely rows in greedy mass windows holding at least `crowd` of them."""
    others = report.where((F.col("class") != CLASS_LIKELY) & F.col("mz").isNotNull())
    windows = anchored_windows(others, [], "mz", lambda a: a + a * ppm * 1e-6)
    counts = others.groupBy("mz").agg(F.count(F.lit(1)).alias("n")).join(windows, "mz")
    crowded = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= crowd)
    masses = windows.join(crowded, "anchor", "left_semi").select("mz")
    is_likely = F.col("class") == CLASS_LIKELY
    return report.where(is_likely).unionByName(spread_join(report.where(~is_likely), masses, ["mz"], "left_anti"))


def isotope_children(
    features: DataFrame, ppm: float = 1.0, rt_tol: float = 0.5, ccs_pct: float = 0.5, charges: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """Ids of features one isotope step (1/z Da) above another feature with like time and cross-section."""
    steps = F.explode(F.array(*[F.lit(float(z)) for z in charges]))
    base = features.select(F.col("mz").alias("i_mz"), F.col("rt").alias("i_rt"), F.col("ccs").alias("i_ccs")).distinct()
    base = base.withColumn("z", steps).withColumn("i_target", F.col("i_mz") + F.lit(1.0) / F.col("z"))
    probe = features.select("feature_id", "mz", "rt", "ccs").withColumn("z", steps)
    tol = ppm_of("i_mz", ppm) / F.col("z")
    # `z` is a join key: on the candidates it is the probe's, and equal to the base's.
    ok = (
        F.col("mz").between(F.col("i_target") - tol, F.col("i_target") + tol)
        & (F.abs(F.col("rt") - F.col("i_rt")) <= rt_tol)
        & (F.abs(F.col("ccs") - F.col("i_ccs")) / F.col("i_ccs") * F.lit(100.0) <= ccs_pct)
    )
    f = ppm * 1e-6
    g = F.lit(f) / F.col("z")
    shift = g / F.col("z")
    c = ccs_pct / 100.0
    narrowest = f / max(charges)
    bands = [
        Band("i_target", (F.col("mz") + shift) / (F.lit(1.0) + g), (F.col("mz") - shift) / (F.lit(1.0) - g),
             float(2 * narrowest * 0.9), log=True),
        abs_band("i_rt", F.col("rt"), rt_tol),
        Band("i_ccs", F.col("ccs") / F.lit(1 + c), F.col("ccs") / F.lit(1 - c), float(np.log1p(c) - np.log1p(-c)), log=True),
    ]
    return band_semi(probe, base, bands, ok, ["feature_id"], on=("z",))


def deisotope(features: DataFrame, **settings) -> DataFrame:
    """Keeps the lightest feature of every isotope chain: whatever has a lighter neighbour goes."""
    return features.join(isotope_children(features, **settings), "feature_id", "left_anti")


def mass_windows(features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Features with `mz_anchor`, the lowest mass of their greedy ppm window."""
    windows = anchored_windows(features, [], "mz", lambda a: a + a * ppm * 1e-6)
    return spread_join(features, windows.withColumnRenamed("anchor", "mz_anchor"), ["mz"])


def tolerance_split(df: DataFrame, keys: list[str], value: str, tol: float, percent: bool, name: str) -> DataFrame:
    """Splits each group where a value leaves the tolerance around the first value of its part.

    The tolerance is relative (in percent) or absolute; `name` holds the first value of the part.
    """
    if percent:
        windows = anchored_windows(df, keys, value, lambda a: a * (1 + tol / 100))
    else:
        windows = anchored_windows(df, keys, value, lambda a: a + tol)
    return spread_join(df, windows.withColumnRenamed("anchor", name), [*keys, value])


def nested_groups(features: DataFrame, ppm: float = 10.0, ccs_pct: float = 2.0, rt_tol: float = 0.5) -> DataFrame:
    """Mass windows, split by cross-section, split by time: mz_anchor, ccs_anchor, rt_anchor."""
    by_mass = cut_lineage(mass_windows(features, ppm))
    by_ccs = cut_lineage(tolerance_split(by_mass, ["mz_anchor"], "ccs", ccs_pct, True, "ccs_anchor"))
    return tolerance_split(by_ccs, ["mz_anchor", "ccs_anchor"], "rt", rt_tol, False, "rt_anchor")


def merge_nested_groups(grouped: DataFrame, intensity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One feature per nested group: id of the earliest, mean coordinates, highest intensities."""
    keys = ["mz_anchor", "ccs_anchor", "rt_anchor"]
    first = F.min_by("feature_id", F.struct("rt", "feature_id"))
    merged = grouped.groupBy(*keys).agg(
        first.alias("feature_id"), *[F.avg(c).alias(c) for c in ("mz", "rt", "dt", "ccs")]
    )
    kept = merged.select(F.col("feature_id").alias("kept_id"), *keys)
    target = spread_join(grouped.select("feature_id", *keys), kept, keys).select("feature_id", "kept_id")
    moved = intensity.join(target, "feature_id").groupBy(F.col("kept_id").alias("feature_id"), "sample").agg(
        F.max("value").alias("value")
    )
    return merged.drop(*keys), moved


def kendrick_series(features: DataFrame, kmd: str, name: str, ppm: float = 10.0) -> DataFrame:
    """Numbers the runs of close values along a Kendrick-defect column.

    A new run starts where the step to the previous value reaches the margin of both masses.
    """
    order = [kmd, "mz", "feature_id"]
    stepped = cut_lineage(with_previous(features, [], order, [kmd, "mz"]))
    margin = (F.col("mz") + F.col("prev_mz")) * F.lit(ppm * 1e-6)
    starts = F.coalesce(F.abs(F.col(kmd) - F.col(f"prev_{kmd}")) >= margin, F.lit(True)).cast("long")
    return with_running_sum(stepped, [], order, starts, name).drop(f"prev_{kmd}", "prev_mz")
