"""Feature tables, peak lists and libraries derived from the `part` and `lineitem` tables.

The same rows are defined once as DataFrames (`Fixtures`) and once as SQL (`CTES`), so that a
query can be compared between engines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        fam = F.expr("CAST(floor(p_partkey / 20D) AS BIGINT) % 40")
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            fam.alias("fam"),
            F.expr("p_partkey % 20").alias("k"),
            F.expr("CAST(p_size AS BIGINT)").alias("sz"),
            (F.lit(112.9856) + fam * F.lit(3.0307) + F.lit(49.9968) * F.expr("p_partkey % 20")).alias("m0"),
        )

    @cached_property
    def seed(self) -> DataFrame:
        return self.base.select(
            "id",
            "fam",
            F.expr("m0 * (1D + ((sz * 7) % 21 - 10) * 1E-6D)").alias("mz"),
            F.expr("1D + 0.65D * k + (sz % 5) * 0.1D").alias("rt"),
            F.expr("90D + 0.185D * m0 + (sz % 9) + CASE WHEN id % 17 = 0 THEN 60D ELSE 0D END").alias("ccs"),
        )

    @cached_property
    def feature(self) -> DataFrame:
        """Seeds plus planted isotopes, dimers, losses and unsaturated chains, from one scan."""
        chain = "(12D * (3 + id % 30) + 18.9984032D * (2 * (3 + id % 30) - 1)) * 1.00001D"
        variants = F.array(
            *[
                F.expr(f"named_struct('ok', {ok}, 'shift', {shift}L, 'mz', {mz}, 'ccs', {ccs}, 'scale', {scale}D)")
                for ok, shift, mz, ccs, scale in [
                    ("id >= 0", 0, "mz", "ccs", 1),
                    ("id % 13 = 0", 10000000, "mz + 2D", "ccs", 0.001),
                    ("id % 11 = 0", 20000000, "2D * mz + 1.007825D", "ccs", 0.001),
                    ("id % 19 = 0", 30000000, "mz - 43.9898D", "ccs", 0.001),
                    ("id % 23 = 0", 40000000, chain, "100D + 0.17D * (49.9968D * (3 + id % 30))", 0.001),
                ]
            ]
        )
        v = F.explode(F.filter(variants, lambda s: s["ok"])).alias("v")
        return self.seed.select("id", "rt", v).select(
            (F.col("v.shift") + F.col("id")).alias("feature_id"),
            F.col("v.mz").alias("mz"),
            "rt",
            (F.col("rt") * F.lit(11.0)).alias("dt"),
            F.col("v.ccs").alias("ccs"),
            F.col("id").alias("src"),
            F.col("v.scale").alias("scale"),
        )

    @cached_property
    def intensity(self) -> DataFrame:
        slot = F.expr("l_suppkey % 8")
        summed = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("src"), slot.alias("slot"))
            .agg(F.sum(F.rint("l_extendedprice")).alias("total"))
        )
        blank = F.col("slot") < 3
        # Spark takes a compressed file for the size of the features made of it, and would broadcast millions of them.
        return self.feature.select("feature_id", "src", "scale").hint("merge").join(summed, "src").select(
            "feature_id",
            F.concat(F.lit("S"), F.col("slot").cast("string")).alias("sample"),
            F.when(blank, "blank").otherwise("exp").alias("role"),
            (F.col("total") * F.col("scale") * F.when(blank, 0.2).otherwise(1.0)).alias("value"),
        )

    @cached_property
    def library_l2(self) -> DataFrame:
        return self.base.where("fam % 4 = 0").select(
            F.expr("fam * 100 + k").alias("lib_id"),
            F.expr("concat('L2-', CAST(fam AS STRING), '-', CAST(k AS STRING))").alias("name"),
            F.lit("M-H").alias("adduct"),
            F.col("m0").alias("mz"),
            F.expr("94D + 0.185D * m0 + (fam % 3)").alias("ccs"),
            F.expr("1.2D + 0.65D * k").alias("rt"),
        ).distinct()

    @cached_property
    def library_l5(self) -> DataFrame:
        return self.base.where("fam % 4 = 1").select(
            F.expr("fam * 100 + k").alias("lib_id"),
            F.expr("concat('L5-', CAST(fam AS STRING), '-', CAST(k AS STRING))").alias("name"),
            F.col("m0").alias("mz"),
        ).distinct()

    @cached_property
    def standard(self) -> DataFrame:
        return self.base.where("fam % 4 = 2").select(
            F.expr("fam * 100 + k").alias("std_id"),
            F.expr("m0 + (k % 2)").alias("mz"),
            F.expr("94D + 0.185D * m0").alias("ccs"),
        ).distinct()

    @cached_property
    def peak(self) -> DataFrame:
        exp = self.intensity.where("role = 'exp'")
        step = F.explode(F.expr("sequence(0, CAST(least(src % 4, 2) AS INT))")).alias("n")
        return exp.join(self.feature.hint("merge"), "feature_id").select("*", step).select(
            F.concat("sample", F.lit(".cef")).alias("source_file"),
            F.col("feature_id").alias("compound"),
            "rt",
            "dt",
            "ccs",
            F.expr("mz + 1.00335D * n").alias("peak_mz"),
            F.expr("CASE WHEN n = 1 AND src % 13 = 0 THEN NULL ELSE value * power(0.011145D * (5 + src % 20), n) END").alias("peak_intensity"),
        )

    @cached_property
    def exp_sample(self) -> DataFrame:
        return self.intensity.where("role = 'exp'").select("sample").distinct()

    @cached_property
    def exp_intensity(self) -> DataFrame:
        return self.intensity.where("role = 'exp'").select("feature_id", "sample", "value")


CTES = """
base AS (
  SELECT p_partkey AS id, CAST(floor(p_partkey/20E0) AS BIGINT) % 40 AS fam, p_partkey % 20 AS k,
         CAST(p_size AS BIGINT) AS sz,
         112.9856E0 + (CAST(floor(p_partkey/20E0) AS BIGINT) % 40) * 3.0307E0 + 49.9968E0 * (p_partkey % 20) AS m0
  FROM part),
seed AS (
  SELECT id, fam, m0 * (1E0 + ((sz*7) % 21 - 10) * 1E-6) AS mz, 1E0 + 0.65E0*k + (sz % 5)*0.1E0 AS rt,
         90E0 + 0.185E0*m0 + (sz % 9) + CASE WHEN id % 17 = 0 THEN 60E0 ELSE 0E0 END AS ccs
  FROM base),
feature AS (
  SELECT id AS feature_id, mz, rt, rt*11E0 AS dt, ccs, id AS src, 1E0 AS scale FROM seed
  UNION ALL SELECT 10000000+id, mz+2E0, rt, rt*11E0, ccs, id, 0.001E0 FROM seed WHERE id%13=0
  UNION ALL SELECT 20000000+id, 2E0*mz+1.007825E0, rt, rt*11E0, ccs, id, 0.001E0 FROM seed WHERE id%11=0
  UNION ALL SELECT 30000000+id, mz-43.9898E0, rt, rt*11E0, ccs, id, 0.001E0 FROM seed WHERE id%19=0
  UNION ALL SELECT 40000000+id, (12E0*(3+id%30) + 18.9984032E0*(2*(3+id%30)-1)) * 1.00001E0, rt, rt*11E0,
                   100E0+0.17E0*(49.9968E0*(3+id%30)), id, 0.001E0 FROM seed WHERE id%23=0),
summed AS (
  SELECT l_partkey AS src, l_suppkey % 8 AS slot, sum(round_even(l_extendedprice, 0)) AS total
  FROM lineitem GROUP BY 1, 2),
intensity AS (
  SELECT f.feature_id, concat('S', CAST(s.slot AS VARCHAR)) AS sample,
         CASE WHEN s.slot < 3 THEN 'blank' ELSE 'exp' END AS role,
         s.total * f.scale * CASE WHEN s.slot < 3 THEN 0.2E0 ELSE 1E0 END AS value
  FROM feature f JOIN summed s ON s.src = f.src),
exp_i AS (SELECT feature_id, sample, value FROM intensity WHERE role = 'exp'),
library_l2 AS (
  SELECT DISTINCT fam*100+k AS lib_id, concat('L2-',CAST(fam AS VARCHAR),'-',CAST(k AS VARCHAR)) AS name,
         'M-H' AS adduct, m0 AS mz, 94E0+0.185E0*m0 + (fam%3) AS ccs, 1.2E0+0.65E0*k AS rt
  FROM base WHERE fam%4=0),
library_l5 AS (
  SELECT DISTINCT fam*100+k AS lib_id, concat('L5-',CAST(fam AS VARCHAR),'-',CAST(k AS VARCHAR)) AS name, m0 AS mz
  FROM base WHERE fam%4=1),
standard AS (
  SELECT DISTINCT fam*100+k AS std_id, m0 + (k%2) AS mz, 94E0+0.185E0*m0 AS ccs FROM base WHERE fam%4=2),
peak AS (
  SELECT concat(i.sample,'.cef') AS source_file, i.feature_id AS compound, f.rt, f.dt, f.ccs,
         f.mz + 1.00335E0*n.n AS peak_mz, CASE WHEN n.n = 1 AND f.src % 13 = 0 THEN NULL ELSE i.value * power(0.011145E0*(5+f.src%20), n.n) END AS peak_intensity
  FROM exp_i i JOIN feature f ON f.feature_id=i.feature_id
  JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) n ON n.n <= f.src % 4)
"""
