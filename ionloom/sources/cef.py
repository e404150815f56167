"""Peak lists in CEF (XML) files.

The text source splits a file after every closing Compound tag, so that one record is one compound,
also in files far larger than a task's memory; Spark's XML function parses the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.ordered import with_rank
from ionloom.session import cut_lineage

_COMPOUND = (
    "Location STRUCT<_rt: STRING, _ccs: STRING, _dt: STRING>, "
    "Spectrum ARRAY<STRUCT<MSPeaks: ARRAY<STRUCT<p: ARRAY<STRUCT<_x: STRING, _y: STRING>>>>>>, "
    "_bad STRING"
)


def read_cef(spark: SparkSession, folder: str, name: str = r"([^/]+)$") -> DataFrame:
    """Peaks of every *.cef file: source_file, compound, rt, dt, ccs, peak_mz, peak_intensity.

    Compounds are numbered from 1 in document order within their file, skipping those without a
    Location. A file with a compound that does not parse, or that breaks off, yields no rows.
    `folder` may be a pattern, so that the files of many folders are read side by side; `name` is the
    pattern whose group is a file's name in its path, which has to differ from file to file.
    """
    lines = spark.read.option("pathGlobFilter", "*.cef").option("lineSep", "</Compound>").text(folder)
    body = F.regexp_extract("value", r"(?s)(<Compound(?:\s(?:[^>]*[^>/])?)?>.*)$", 1)
    records = lines.select(
        F.regexp_extract("_metadata.file_path", name, 1).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").rlike(r"</[A-Za-z][\w.:-]*\s*>\s*$").alias("closed"),
        F.nullif(body, F.lit("")).alias("body"),
    )
    # One pass parses all records, and keeps of the others only whether they may end a file.
    parsed = cut_lineage(
        records.select(
            "source_file", "block", "row", "closed", F.col("body").isNotNull().alias("found"),
            F.from_xml(
                F.concat("body", F.lit("</Compound>")), _COMPOUND, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
            ).alias("c"),
        )
    )
    broken = parsed.where("found AND (c._bad IS NOT NULL OR c IS NULL)").select("source_file").unionByName(
        parsed.groupBy("source_file")
        .agg(F.max_by("closed", F.struct("block", "row")).alias("closed"))
        .where("NOT closed")
        .select("source_file")
    )
    located = parsed.where("found AND c.Location IS NOT NULL").join(broken.distinct(), "source_file", "left_anti")
    numbered = with_rank(located, ["source_file"], ["block", "row"], "compound")
    peaks = F.explode(F.flatten(F.flatten(F.transform("c.Spectrum", lambda s: F.transform(s["MSPeaks"], lambda m: m["p"])))))
    number = lambda path: F.expr(f"try_cast({path} AS DOUBLE)")
    return numbered.select(
        "source_file", F.col("compound").cast("int").alias("compound"),
        number("c.Location._rt").alias("rt"), number("c.Location._dt").alias("dt"), number("c.Location._ccs").alias("ccs"),
        peaks.alias("p"),
    ).select(
        "source_file", "compound", "rt", "dt", "ccs", number("p._x").alias("peak_mz"), number("p._y").alias("peak_intensity")
    )


def cef_samples(peaks: DataFrame) -> DataFrame:
    """Sample names: file names without the extension."""
    return peaks.select(F.trim(F.regexp_replace("source_file", r"\.cef$", "")).alias("sample")).distinct()
