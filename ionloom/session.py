"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "ionloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to adaptive execution: start high, let it coalesce. Skewed
    shuffle partitions of the remaining equi-joins are split by the adaptive skew join.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; only a purely local session may have one made for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        folder = tempfile.mkdtemp(prefix="ionloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new name for tables in the shared folder."""
    return f"{shared_folder(spark)}/ionloom-{name}-{uuid.uuid4().hex}"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, the plan restarts there."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """Checkpoint that also counts the rows meeting a condition on their way out."""
    seen = Observation()
    kept = cut_lineage(df.observe(seen, F.count_if(F.expr(condition)).alias("rows")))
    return kept, seen.get["rows"]
