"""From files to files: screening of delimited feature lists, and isotope summaries of a folder of peak lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.model import Params
from ionloom.operators import cleanup, isotope, match, report
from ionloom.plans.isotopes import isotope_summary
from ionloom.plans.screen import Screening, screen
from ionloom.session import cut_lineage
from ionloom.sources import cef, delimited


@dataclass
class FileScreening:
    """The screening, its report with metadata, sample columns and error texts, and the names of the samples."""

    screening: Screening
    report: DataFrame
    samples: list[str]


def run_screening(
    spark: SparkSession,
    paths: list[str],
    columns: dict[str, str],
    blanks: tuple[str, str],
    experimental: tuple[str, str],
    level2: DataFrame,
    level5: DataFrame | None = None,
    standards: DataFrame | None = None,
    report_path: str | None = None,
    params: Params = Params(),
    table_path: str | None = None,
) -> FileScreening:
    """Reads the files, screens them and, with `report_path`, writes the report as CSV parts in the order of class, then mass.

    With `table_path` the report is also written as Parquet, in a folder per class.

    `columns` maps feature_id, mz, rt, dt and ccs to column letters; `blanks` and `experimental` are inclusive
    letter ranges. Ids must be unique over all files. Other columns are carried along: of merged features,
    numbers by their maximum, texts from the one with the lowest m/z.
    """
    raw = delimited.read_delimited(spark, paths)
    table = delimited.map_columns(raw, columns)
    blank, exp, _ = delimited.split_roles([c for c in table.columns if c != "source_file"], blanks, experimental)
    features, intensity = delimited.to_long(table, blank, exp)
    features = delimited.require_unique_ids(cut_lineage(features))
    result = screen(features.select("feature_id", "mz", "rt", "dt", "ccs"), intensity, level2, level5, standards, params)
    meta = cleanup.merge_metadata(features, result.members)
    full = delimited.to_wide(report.error_text(result.report).join(meta, "feature_id", "left"), result.intensity, exp)
    full = cut_lineage(full)
    if report_path:
        texts = full.withColumns({
            "mass_errors_ppm": F.array_join(F.transform("mass_errors_ppm", lambda e: e.cast("string")), " or "),
            "meta": F.to_json("meta"),
        })
        delimited.write_report(texts, report_path, order=[match.class_rank(), "mz", "feature_id"])
    if table_path:
        delimited.write_table(full, table_path, ["class"])
    return FileScreening(result, full, exp)


def run_isotopes(
    spark: SparkSession, screened: FileScreening, folder: str, grid: DataFrame | None = None, params: Params = Params()
) -> DataFrame:
    """Isotope summary of the screened features and the CEF files of a folder.

    A file belongs to the sample column with its name, else to the first column that contains it.
    """
    peaks = cut_lineage(cef.read_cef(spark, folder))
    named = isotope.resolve_samples(cef.cef_samples(peaks), screened.samples)
    values = screened.screening.intensity.withColumnRenamed("sample", "column").join(named, "column").select("feature_id", "sample", "value")
    return isotope_summary(screened.screening.report, values, peaks, grid, params)
