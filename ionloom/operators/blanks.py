"""Blank subtraction, detection frequency and other per-feature statistics over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subtract_blanks(intensity: DataFrame, method: str = "2", sds: float = 3.0) -> DataFrame:
    """Experimental intensities less the blank level of their feature, never below 0.

    Method 1 takes the highest blank, method 2 the mean plus `sds` sample standard deviations (0 for
    a single blank). Without any blank value the result is missing. Two scans: the blanks are
    aggregated by feature, before and after the shuffle, and the levels joined to the experimental rows.
    """
    if method == "1":
        level = F.max("_blank")
    elif method == "2":
        level = F.avg("_blank") + F.coalesce(F.stddev_samp("_blank"), F.lit(0.0)) * F.lit(float(sds))
    else:
        raise ValueError(f"blank method must be '1' or '2', not {method!r}")
    blanks = intensity.where("role = 'blank'").withColumn("_blank", F.col("value"))
    levels = blanks.groupBy("feature_id").agg(level.alias("_level"))
    left = intensity.where("role = 'exp'").join(levels, "feature_id", "left")
    less = F.col("value") - F.col("_level")
    return left.select("feature_id", "sample", F.when(less < 0, 0.0).otherwise(less).alias("value"))


def common_features(blank: DataFrame, experimental: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each side whose feature is present on the other one too."""
    return (
        blank.join(experimental.select("feature_id"), "feature_id", "left_semi"),
        experimental.join(blank.select("feature_id"), "feature_id", "left_semi"),
    )


def detection(intensity: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature: detection frequency in percent of all samples, and the mean of the known values."""
    n = samples.agg(F.count_distinct("sample").cast("double")).scalar()
    per_feature = intensity.groupBy("feature_id").agg(
        F.count_if(F.col("value") > 0).alias("_hits"), F.avg("value").alias("average_abundance")
    )
    return per_feature.select(
        "feature_id",
        (F.col("_hits") / n * F.lit(100.0)).alias("detection_frequency"),
        "average_abundance",
    )


def filter_by_frequency(features: DataFrame, intensity: DataFrame, samples: DataFrame, pct: float) -> DataFrame:
    """Features seen (value > 0) in at least `pct` percent of all samples."""
    n = samples.agg(F.count_distinct("sample").cast("double")).scalar()
    hits = intensity.groupBy("feature_id").agg(F.count_if(F.col("value") > 0).alias("_hits"))
    frequent = hits.where(F.col("_hits") / n >= F.lit(pct / 100.0))
    kept = features.join(frequent.select("feature_id"), "feature_id", "left_semi")
    return features if pct <= 0 else kept


def nonzero_stats(intensity: DataFrame, minimum: float = 0.001) -> DataFrame:
    """One row: mean and sample deviation, over samples, of the number of values above `minimum`."""
    per_sample = intensity.groupBy("sample").agg(F.count_if(F.col("value") > minimum).alias("n"))
    return per_sample.agg(F.rint(F.avg("n")).alias("mean_count"), F.rint(F.stddev_samp("n")).alias("sd_count"))
