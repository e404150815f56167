"""Homologous series: repeat-unit edges, groups, refinement and trend validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.model import CLASS_STANDARD
from ionloom.operators.components import connected_components
from ionloom.operators.ordered import anchored_windows, neighbours, with_previous
from ionloom.operators.skew import spread_join
from ionloom.session import cut_lineage

SPACING = 10.0


def stack_library(report: DataFrame, library: DataFrame, samples: list[str] = ()) -> DataFrame:
    """Library rows under the features, as class 'External Standard' with negative row ids.

    Only intensities are filled with 0; a missing retention time stays missing.
    """
    top = report.select(
        F.col("feature_id").alias("row_id"), F.col("match").alias("name"), "class", "ccs", "rt", "mz", *samples
    )
    bottom = library.select(
        (-F.col("lib_id") - 1).alias("row_id"), "name", F.lit(CLASS_STANDARD).alias("class"), "ccs", "rt", "mz",
        *[F.lit(0.0).alias(s) for s in samples],
    )
    stacked = top.unionByName(bottom)
    return stacked.withColumns({s: F.coalesce(s, F.lit(0.0)) for s in samples}) if samples else stacked


def series_edges(rows: DataFrame, units: dict[str, float], ppm: float = 10.0, multiples: int = 3) -> DataFrame:
    """Distinct masses mz -> mz_to one to `multiples` repeat units above, nearest to the target.

    The answer depends on the masses only, so each distinct mass is searched once, in the merged
    order of masses and targets. Of two equally near masses the lower one is taken.
    """
    masses = rows.where("mz IS NOT NULL AND ccs IS NOT NULL").select("mz").distinct()
    steps = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("unit"), F.lit(k).alias("multiple"), F.lit(mass * k).alias("shift"))
                for name, mass in units.items()
                for k in range(1, multiples + 1)
            ]
        )
    )
    masses = cut_lineage(masses)
    targets = masses.select("mz", steps.alias("s")).select(
        "mz", "s.unit", "s.multiple", (F.col("mz") + F.col("s.shift")).alias("target")
    )
    near = neighbours(masses, targets, [], "mz", "target", strict=False)
    tol = F.lit(ppm / 1e6) * F.col("target")
    lo, hi = F.col("target") - tol, F.col("target") + tol
    below = F.when((F.col("below") >= lo) & (F.col("below") > F.col("mz")), F.col("below"))
    above = F.when((F.col("above") <= hi) & (F.col("above") > F.col("mz")), F.col("above"))
    nearer_above = F.abs(above - F.col("target")) < F.abs(below - F.col("target"))
    to = F.when(below.isNull(), above).when(above.isNull(), below).when(nearer_above, above).otherwise(below)
    return near.select("mz", "unit", "multiple", to.alias("mz_to")).where("mz_to IS NOT NULL")


def series_groups(
    rows: DataFrame, units: dict[str, float], ppm: float = 10.0, min_points: int = 3, multiples: int = 3
) -> DataFrame:
    """Rows of valid series with group_id (lowest row id of the series) and repeating_unit.

    Every row points at the first row of its target mass. Hence rows of a mass with a target are all
    in one series; of a mass without one, only the first row can be, as somebody's target.
    """
    rows = cut_lineage(rows.where("mz IS NOT NULL AND ccs IS NOT NULL"))
    edges = cut_lineage(series_edges(rows, units, ppm, multiples).select("mz", "mz_to").distinct())
    linked = connected_components(edges, "mz", "mz_to").withColumnRenamed("node", "mz")
    sources = edges.select("mz", F.lit(True).alias("has_target")).distinct()
    first = rows.groupBy("mz").agg(F.min("row_id").alias("first_row"))
    nodes = linked.join(sources, "mz", "left").join(first, "mz")
    member = F.coalesce("has_target", F.lit(False)) | (F.col("row_id") == F.col("first_row"))
    members = cut_lineage(spread_join(rows, nodes, ["mz"]).where(member).select(*rows.columns, "component"))
    spaced = anchored_windows(members, ["component"], "mz", lambda a: a + SPACING, closed=False)
    points = spaced.groupBy("component").agg(F.count_distinct("anchor").alias("points"))
    valid = (
        members.groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("size"), F.min("row_id").alias("group_id"),
            F.bool_or(F.col("class") != CLASS_STANDARD).alias("has_feature"),
        )
        .join(points, "component")
        .where((F.col("size") >= min_points) & (F.col("points") >= min_points) & F.col("has_feature"))
    )
    return spread_join(members, valid.select("component", "group_id"), ["component"]).select(
        *rows.columns, "group_id", F.lit(next(iter(units))).alias("repeating_unit")
    )


def _well_spaced() -> Column:
    step = F.col("mz") - F.col("prev_mz")
    return F.count_if(F.coalesce(step >= SPACING, F.lit(True)))


def refine_groups(groups: DataFrame, min_points: int = 3) -> DataFrame:
    """Drops points that break the rise of CCS or RT at a step of 10 Da or more, then thin groups."""
    order = ["mz", "row_id"]
    seen = with_previous(groups, ["group_id"], order, ["mz", "ccs", "rt"])
    falls = F.coalesce(F.col("ccs") <= F.col("prev_ccs"), F.lit(False)) | F.coalesce(F.col("rt") <= F.col("prev_rt"), F.lit(False))
    drop = F.coalesce(F.col("mz") - F.col("prev_mz") >= SPACING, F.lit(False)) & falls
    kept = cut_lineage(seen.where(~drop).select(*groups.columns))
    again = with_previous(kept, ["group_id"], order, ["mz"])
    enough = again.groupBy("group_id").agg(_well_spaced().alias("n")).where(F.col("n") >= min_points)
    return spread_join(kept, enough.select("group_id"), ["group_id"], "left_semi")


def validate_trends(
    outcome: DataFrame, min_points: int, min_library: int, min_r2: float | None = None
) -> DataFrame:
    """Flags whole groups as outliers when their non-outliers are too few, too close or lack standards."""
    result = outcome
    good = outcome.where("NOT is_outlier")
    checks = []
    if min_points > 0:
        stepped = with_previous(good, ["group_id"], ["mz", "row_id"], ["mz"])
        checks.append(stepped.groupBy("group_id").agg(_well_spaced().alias("n")).where(F.col("n") >= min_points))
    if min_library > 0:
        standards = F.count_if(F.col("class") == CLASS_STANDARD)
        checks.append(good.groupBy("group_id").agg(standards.alias("n")).where(F.col("n") >= min_library))
    if min_r2 is not None:
        checks.append(good.groupBy("group_id").agg(F.min("r_squared").alias("n")).where(F.col("n") >= min_r2))
    for passed in checks:
        result = spread_join(result, passed.select("group_id", F.lit(True).alias("_ok")), ["group_id"], "left").withColumn(
            "is_outlier", F.col("is_outlier") | F.col("_ok").isNull()
        ).drop("_ok")
    return result
