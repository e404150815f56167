"""Isotope metrics from peak lists, matching to the report, alignment and summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.numeric import half_even, ppm_of
from ionloom.operators.bands import Band, band_join, ppm_band
from ionloom.operators.components import box_components
from ionloom.operators.ordered import neighbours, with_rank
from ionloom.operators.skew import spread_join
from ionloom.session import cut_lineage

# Share of C-13, and the M+2 ratio above which chlorine or bromine is assumed.
NATURAL_C13 = 0.011145
RATIO_CL_BR = 0.28


def with_sample(peaks: DataFrame) -> DataFrame:
    """Adds `sample`: the file name without folder and extension."""
    return peaks.withColumn("sample", F.trim(F.regexp_replace("source_file", r"^.*/|\.[^.]*$", "")))


def multi_peak_compounds(peaks: DataFrame) -> DataFrame:
    """Peaks of compounds with more than one peak of known mass."""
    keys = ["source_file", "compound"]
    many = peaks.groupBy(*keys).agg(F.count("peak_mz").alias("n")).where("n > 1")
    return spread_join(peaks, many.select(*keys), keys, "left_semi")


def first_peaks(peaks: DataFrame) -> DataFrame:
    """Mass and intensity of the three lightest peaks per compound with two peaks or more.

    The rank limit is applied before the shuffle, so a compound with very many peaks stays cheap.
    """
    keys = ["source_file", "compound"]
    w = Window.partitionBy(*keys).orderBy(F.col("peak_mz").asc_nulls_last(), "peak_intensity")
    ranked = peaks.select(*keys, "peak_mz", "peak_intensity", F.row_number().over(w).alias("n")).where("n <= 3")
    picks = [
        F.max(F.when(F.col("n") == i, F.col(c))).alias(f"{name}_{i}")
        for i in (1, 2, 3)
        for c, name in (("peak_mz", "peak_mz"), ("peak_intensity", "intensity"))
    ]
    return ranked.groupBy(*keys).agg(*picks, F.max("n").alias("n")).where("n >= 2").drop("n", "peak_mz_3")


def carbon_estimate(peaks: DataFrame) -> DataFrame:
    """Carbon number from the M+1 ratio, and mass and mass defect per carbon, per compound.

    Compounds whose ratio is zero or has no denominator go; one with a missing intensity stays without a number.
    """
    c = (F.col("intensity_2") / F.col("intensity_1")) * F.lit(1 / NATURAL_C13)
    defect = F.col("peak_mz_1") - F.rint("peak_mz_1")
    return (
        first_peaks(peaks)
        .where("NOT (intensity_1 <=> 0D)")
        .withColumn("carbon_estimate", c)
        .where("NOT (carbon_estimate <=> 0D)")
        .withColumns({
            "m_over_c": F.col("peak_mz_1") / F.col("carbon_estimate"),
            "mass_defect": defect,
            "md_over_c": defect / F.col("carbon_estimate"),
        })
    )


def halogen_class(metrics: DataFrame) -> DataFrame:
    """Ratio of the M+2 to the M peak and what it says about chlorine or bromine."""
    ratio = F.when(F.col("intensity_1") > 0, F.col("intensity_3") / F.col("intensity_1"))
    # The three texts.
    label = (
        F.when(ratio > RATIO_CL_BR, "Potential Cl, Br present")
        .when((F.col("intensity_3") == 0) | F.col("intensity_3").isNull(), "No M+2 peak detected - insufficient signal")
        .otherwise("No Cl or Br isotopic pattern detected")
    )
    return metrics.withColumns({"m2_ratio": ratio, "isotope_status": label})


def resolve_samples(names: DataFrame, columns: list[str]) -> DataFrame:
    """(sample, column): the column with the sample's name, else the first column containing it."""
    table = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    hit = F.filter(table, lambda c: c["name"].contains(F.col("sample")))
    exact = F.filter(table, lambda c: c["name"] == F.col("sample"))
    column = F.coalesce(F.get(exact, 0)["name"], F.get(hit, 0)["name"])
    return names.select("sample", column.alias("column")).where("column IS NOT NULL")


def sample_anchors(
    features: DataFrame, intensity: DataFrame, peaks: DataFrame, ppm: float = 10.0, ccs_pct: float = 2.0, rt_tol: float = 1.0,
    by_feature: bool = True,
) -> DataFrame:
    """Per sample: features and peaks that agree in mass, cross-section, time and rounded intensity.

    `intensity` is keyed by the peak files' sample names. One plan over all samples: sample and
    rounded intensity are equi keys next to the mass band, so candidates are few from the start. Without `by_feature` features that
    differ in nothing but their id are matched as one, which `distinct_anchors` would make of them afterwards.
    """
    seen = intensity.where("value > 0").join(features.hint("merge"), "feature_id").withColumn("anchor", F.rint("value"))
    if not by_feature:
        seen = seen.select("sample", "anchor", "value", *[c for c in ("match", "class", "mz", "rt", "dt", "ccs") if c in features.columns]).distinct()
    candidates = cut_lineage(with_sample(multi_peak_compounds(peaks)).select(
        "sample", "compound", F.col("rt").alias("p_rt"), F.col("ccs").alias("p_ccs"), "peak_mz", "peak_intensity",
        F.rint("peak_intensity").alias("anchor"),
    ))
    near = (F.col("peak_mz") >= F.col("mz") - ppm_of("mz", ppm)) & (F.col("peak_mz") <= F.col("mz") + ppm_of("mz", ppm))
    ccs_diff = F.abs(F.col("ccs") - F.col("p_ccs")) / F.col("ccs") * F.lit(100.0)
    rt_diff = F.abs(F.col("rt") - F.col("p_rt"))
    found = band_join(
        seen, candidates, [ppm_band("peak_mz", F.col("mz"), ppm)], near & (ccs_diff <= ccs_pct) & (rt_diff <= rt_tol),
        on=("sample", "anchor"),
    )
    return found.select(
        "sample", "compound", *["feature_id"] * by_feature, *[c for c in ("match", "class") if c in features.columns], "mz", "rt", "dt", "ccs",
        F.col("value").alias("intensity"), "peak_mz", "peak_intensity",
        (F.abs(F.col("mz") - F.col("peak_mz")) / F.col("mz") * F.lit(1e6)).alias("ppm_error"),
        ccs_diff.alias("ccs_diff_pct"), rt_diff.alias("rt_diff"),
    )


_ANCHOR = ["sample", "compound", "match", "class", "mz", "rt", "dt", "ccs", "intensity"]


def distinct_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.select(*[c for c in _ANCHOR if c in anchors.columns]).distinct()


def sample_report(anchors: DataFrame, peaks: DataFrame) -> DataFrame:
    """Anchors with every peak of their compound and the compound's isotope metrics."""
    kept = distinct_anchors(anchors)
    named = with_sample(peaks)
    pair = ["sample", "compound"]
    wanted = cut_lineage(spread_join(named, kept.select(*pair).distinct(), pair, "left_semi"))
    metrics = with_sample(carbon_estimate(wanted.drop("sample"))).drop("source_file")
    detail = wanted.select(
        "sample", "compound", F.col("rt").alias("peak_rt"), F.col("dt").alias("peak_dt"), F.col("ccs").alias("peak_ccs"),
        "peak_mz", "peak_intensity",
    )
    # Anchors come from peaks, so none is lost by starting from the peaks, the side that can be large.
    return spread_join(spread_join(detail, kept, pair), metrics, pair, "left")


def anchors_with_metrics(anchors: DataFrame, peaks: DataFrame) -> DataFrame:
    """Anchors with the isotope metrics of their compound, computed only if they are not there yet."""
    if "carbon_estimate" in anchors.columns:
        return anchors
    metrics = with_sample(carbon_estimate(peaks)).drop("source_file")
    return distinct_anchors(anchors).join(metrics, ["sample", "compound"], "left")


def align(rows: DataFrame, ppm: float = 10.0, ccs_pct: float = 2.0, hot_cell: int | None = None) -> DataFrame:
    """Adds alignment_id: compounds of different samples with like mass and cross-section belong together.

    Like means within the tolerances around either of the two. The id is the lowest sample/compound
    of the aligned set; all rows of a compound share it.
    """
    key = F.concat_ws("/", "sample", F.format_string("%019d", F.col("compound")))
    keyed = cut_lineage(rows.withColumn("_key", key))
    f, c = ppm * 1e-6, ccs_pct / 100.0
    mz, q_mz, ccs, q_ccs = (F.col(n) for n in ("mz", "q_mz", "ccs", "q_ccs"))
    wide_m, wide_c = float(np.log1p(f)), float(np.log1p(c))

    def around(base_mz, base_ccs, other_mz, other_ccs):
        return other_mz.between(base_mz - ppm_of(base_mz, ppm), base_mz + ppm_of(base_mz, ppm)) & (
            F.abs(base_ccs - other_ccs) / base_ccs * F.lit(100.0) <= ccs_pct
        )

    outward = (
        [
            Band("q_mz", mz * F.lit(1 - f), mz * F.lit(1 + f), wide_m, log=True),
            Band("q_ccs", ccs * F.lit(1 - c), ccs * F.lit(1 + c), wide_c, log=True),
        ],
        around(mz, ccs, q_mz, q_ccs),
    )
    inward = (
        [
            Band("q_mz", mz / F.lit(1 + f), mz / F.lit(1 - f), wide_m, log=True),
            Band("q_ccs", ccs / F.lit(1 + c), ccs / F.lit(1 - c), wide_c, log=True),
        ],
        around(q_mz, q_ccs, mz, ccs),
    )
    points = keyed.where("mz > 0 AND ccs > 0").select("_key", "mz", "ccs", "sample").distinct()
    groups = box_components(points, "_key", ["mz", "ccs"], [outward, inward], sample="sample", hot_cell=hot_cell)
    ids = groups.select("_key", F.col("component").alias("alignment_id")).distinct()
    return spread_join(keyed, ids, ["_key"], "left").withColumn("alignment_id", F.coalesce("alignment_id", "_key")).drop("_key")


_MEANS = [
    "mz", "ccs", "dt", "rt", "carbon_estimate", "m_over_c", "mass_defect", "md_over_c", "peak_mz_1", "intensity_1",
    "intensity_2", "intensity_3",
]


def alignment_summary(aligned: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Per alignment: first name and class, means, deviations, mean intensity and detection count.

    The mean intensity counts 0 for samples without a value. With a list of samples, `sample_values` holds the mean intensity
    of each of them in that order, 0 where there is none: one array per alignment, filled by position, whatever the number of
    samples. `widen_samples` makes columns of it where a sink needs them.
    """
    texts_there = [c for c in ("class", "match") if c in aligned.columns]
    first = F.struct("sample", "compound", "mz", *texts_there)  # a feature can have several annotations
    texts = [F.min_by(c, first).alias(c) for c in reversed(texts_there)]
    means = [F.avg(c).alias(c) for c in _MEANS if c in aligned.columns]
    spread = [F.stddev_samp(c).alias(f"{c}_sd") for c in ("carbon_estimate", "m_over_c", "mass_defect") if c in aligned.columns]
    summary = aligned.groupBy("alignment_id").agg(*texts, *means, *spread)
    per_sample = aligned.groupBy("alignment_id", "sample").agg(F.avg("intensity").alias("value"))
    n = aligned.agg(F.count_distinct("sample").cast("double")).scalar()
    totals = [F.sum("value").alias("_sum"), F.count("value").alias("detection_count")]
    if samples:
        places = aligned.sparkSession.createDataFrame([(name, i) for i, name in enumerate(samples)], "sample string, _place int")
        per_sample = per_sample.join(F.broadcast(places), "sample", "left")  # as long as the list given
        there = F.when(F.col("_place").isNotNull() & F.col("value").isNotNull(), F.struct("_place", "value"))
        totals.append(F.map_from_entries(F.collect_list(there)).alias("_by_place"))
    merged = per_sample.groupBy("alignment_id").agg(*totals)
    columns = ["alignment_id", (F.coalesce("_sum", F.lit(0.0)) / n).alias("mean_intensity"), "detection_count"]
    if samples:
        at = F.sequence(F.lit(0), F.lit(len(samples) - 1))
        columns.append(F.transform(at, lambda i: F.coalesce(F.element_at("_by_place", i), F.lit(0.0))).alias("sample_values"))
    return summary.join(merged.select(*columns), "alignment_id", "left")


def widen_samples(summary: DataFrame, samples: list[str]) -> DataFrame:
    """`sample_values` as one column per sample, for a sink that wants them."""
    return summary.select(
        *[c for c in summary.columns if c != "sample_values"], *[F.get("sample_values", i).alias(name) for i, name in enumerate(samples)]
    )


def _brackets(grid: DataFrame, axis: str, rows: DataFrame, value: str) -> DataFrame:
    """(v, lo, hi): for each distinct value on the grid's axis the nodes around it; the last node belongs to the interval before it."""
    nodes = cut_lineage(grid.select(F.col(axis).alias("node")).where("node IS NOT NULL").distinct())
    following = neighbours(nodes, nodes.withColumnRenamed("node", "v"), [], "node", "v", strict=True)
    following = cut_lineage(following.select(F.col("v").alias("node"), F.col("above").alias("next")))
    inner = following.where("next IS NOT NULL").select("node", F.col("node").alias("lo"), F.col("next").alias("hi"))
    last = following.where("next IS NULL").select(F.col("node").alias("end"))
    outer = inner.join(last, inner["hi"] == last["end"]).select(F.col("end").alias("node"), "lo", "hi")
    values = rows.select(F.col(value).alias("v")).where("v IS NOT NULL").distinct()
    found = neighbours(nodes, values, [], "node", "v", strict=False).where("below IS NOT NULL AND above IS NOT NULL")
    return found.select("v", F.col("below").alias("node")).join(inner.unionByName(outer), "node").select("v", "lo", "hi")


def _cells(grid: DataFrame) -> DataFrame:
    """(_y0, _x0, _z00, _z01, _z10, _z11): the values at the corners of each cell, by its lower corner.

    Each node gives its value to the up to four cells it is a corner of; the cells are found by the numbers of nodes on
    each axis, not by comparing nodes.
    """
    numbered = cut_lineage(grid.select("y", "x", "z"))
    for axis in ("y", "x"):
        nodes = with_rank(cut_lineage(numbered.select(axis).where(F.col(axis).isNotNull()).distinct()), [], [axis], f"_n{axis}")
        numbered = numbered.join(nodes, axis)
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    shared = numbered.select("y", "x", "z", (F.col("_ny")).alias("_ny"), F.col("_nx").alias("_nx"), corners.alias("_c"))
    cell = shared.groupBy((F.col("_ny") - F.col("_c.i")).alias("_cy"), (F.col("_nx") - F.col("_c.j")).alias("_cx"))

    def at(i: int, j: int, what: str):
        return F.max(F.when((F.col("_c.i") == i) & (F.col("_c.j") == j), F.col(what)))

    values = [at(i, j, "z").alias(f"_z{i}{j}") for i in (0, 1) for j in (0, 1)]
    return cell.agg(at(0, 0, "y").alias("_y0"), at(0, 0, "x").alias("_x0"), *values).drop("_cy", "_cx").where("_y0 IS NOT NULL AND _x0 IS NOT NULL")


def grid_ratio(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Bilinear value of grid(y, x, z) at (md_over_c, m_over_c), classified.

    NULL outside the grid or next to an empty node. `ratio` is rounded to one place and NULL when out
    of bounds (no value, or below 0.8); `ratio_status` says which.
    """
    placed = rows
    for value, axis, lo, hi in (("md_over_c", "y", "_y0", "_y1"), ("m_over_c", "x", "_x0", "_x1")):
        brackets = _brackets(grid, axis, rows, value).select(F.col("v").alias(value), F.col("lo").alias(lo), F.col("hi").alias(hi))
        placed = placed.join(brackets, value, "left")
    placed = placed.join(_cells(grid), ["_y0", "_x0"], "left")
    ty = (F.col("md_over_c") - F.col("_y0")) / (F.col("_y1") - F.col("_y0"))
    tx = (F.col("m_over_c") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    z = (
        F.col("_z00") * (1 - ty) * (1 - tx) + F.col("_z01") * (1 - ty) * tx
        + F.col("_z10") * ty * (1 - tx) + F.col("_z11") * ty * tx
    )
    outside = z.isNull() | (z < 0.8)
    return placed.withColumns({
        "ratio": F.when(~outside, half_even(z, 1)),
        "ratio_status": F.when(outside, "out of bounds").otherwise("predicted"),
    }).drop(*[c for c in placed.columns if c.startswith(("_y", "_x", "_z"))])
