"""Mass windows as runs of ranks: all partners of a target in two numbers, whatever their count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.numeric import ppm_of
from ionloom.operators.ordered import with_rank, with_running_sum
from ionloom.operators.skew import spread_join
from ionloom.session import cut_lineage

_LOW, _MASS, _HIGH = 0, 1, 2


def ranked_masses(rows: DataFrame) -> DataFrame:
    """(mz, rank): the distinct masses of `rows`, numbered from 1 in ascending order."""
    return with_rank(cut_lineage(rows.select("mz").where("mz IS NOT NULL").distinct()), [], ["mz"], "rank")


def mass_runs(targets: DataFrame, masses: DataFrame, ppm: float) -> DataFrame:
    """(mz1, label, first_rank, last_rank): the distinct masses within `ppm` of each target that has any.

    `targets` has mz1, label and target, `masses` the distinct mz. The masses in a window are neighbours in the order of
    all masses, so the window is known by the ranks at its borders: how many masses lie below the lower one, and
    how many up to the upper one. Both are read off one pass over masses and borders in their global order, so the output has
    a row per target, and nothing is compared pair by pair.
    """
    window = ppm_of("target", ppm)
    borders = F.explode(
        F.array(F.struct((F.col("target") - window).alias("v"), F.lit(_LOW).alias("kind")), F.struct((F.col("target") + window).alias("v"), F.lit(_HIGH).alias("kind")))
    )
    ends = targets.select("mz1", "label", borders.alias("_b")).select("mz1", "label", F.col("_b.v").alias("_v"), F.col("_b.kind").alias("_kind"))
    points = masses.select(F.col("mz").alias("_v"), F.lit(_MASS).alias("_kind"))
    merged = cut_lineage(ends.unionByName(points, allowMissingColumns=True))
    counted = with_running_sum(merged, [], ["_v", "_kind", "mz1", "label"], (F.col("_kind") == _MASS).cast("long"), "_below")
    runs = counted.where(F.col("_kind") != _MASS).groupBy("mz1", "label").agg(
        F.max(F.when(F.col("_kind") == _LOW, F.col("_below") + 1)).alias("first_rank"),
        F.max(F.when(F.col("_kind") == _HIGH, F.col("_below"))).alias("last_rank"),
    )
    return runs.where("first_rank <= last_rank")


def expand_runs(runs: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mz1, mz2, label): a row per mass of each run; `ranked` is `ranked_masses` of the masses the runs were made from."""
    pairs = runs.select("mz1", "label", F.explode(F.sequence("first_rank", "last_rank")).alias("rank"))
    return spread_join(pairs, ranked.select("rank", F.col("mz").alias("mz2")), ["rank"]).select("mz1", "mz2", "label")
