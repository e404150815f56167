"""Labels, folds and samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(folds: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % folds


def held_out(folds: int, part: int) -> Column:
    """Whether a document is kept from learning; one without an id is not, but has no label either."""
    return F.coalesce(fold(folds) == part, F.lit(False))


def training_labels(spark: SparkSession, sf_dir: str, label: str, folds: int, part: int) -> DataFrame:
    """(doc_id, label) for learning: labels 0 and 1 outside the held-out fold, the larger one of a repeated doc_id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("label"))
    labels = labels.where(F.col("label").isin(0, 1) & (fold(folds) != part))
    return labels.groupBy("doc_id").agg(F.max("label").alias("label"))
