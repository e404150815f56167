"""Rounding and text for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ionloom.functions.numeric import half_even, shorten

# Decimal places in the report and in the display table.
REPORT_PLACES = {
    "ccs": 1, "rt": 1, "mz": 4, "dt": 2, "mass_error_ppm": 2, "ccs_error_pct": 2, "rt_error": 2,
    "average_abundance": 0, "detection_frequency": 1,
}
SERIES_PLACES = {"ccs": 1, "rt": 1, "mz": 4, "dt": 2}
TABLE_PLACES = {"peak_mz_1": 4, "intensity_1": 0, "ccs": 2, "dt": 2, "rt": 2}
TABLE_LABELS = {
    "match": "Name", "class": "Class", "isotope_status": "Isotope Status", "peak_mz_1": "m/z", "ccs": "CCS", "dt": "DT",
    "rt": "RT", "intensity_1": "Average Abundance", "ratio": "Pred. F/C Ratio",
}
# The levels that get a label, and the texts of the functions below.
MAJOR_LEVELS = [0.8, 1.0, 1.5, 2.0, 2.5, 3.0]
# Slope and intercept of the CF2 and CHF reference lines over m/C.
REFERENCE_LINES = {"CF2": (-8.40596e-05, 0.0010087), "CHF": (-0.0005237, 0.0229902)}


def round_report(df: DataFrame, places: dict[str, int] = REPORT_PLACES) -> DataFrame:
    """Rounds the numeric columns named in `places`, half to even; others are left alone."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rounded = {c: half_even(c, n) for c, n in places.items() if isinstance(kinds.get(c), NumericType)}
    return df.withColumns(rounded) if rounded else df


def error_text(df: DataFrame) -> DataFrame:
    """Report text of the error columns: suspects' errors joined by ' or ', 'N/A' where there is none."""
    many = F.array_join(F.transform("mass_errors_ppm", lambda e: e.cast("string")), " or ")
    single = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    tentative = F.col("class") == "tentative"
    known = F.col("class") == "unmatched"
    return df.withColumns({
        "mass_error_text": F.when(tentative, many).when(~known, single("mass_error_ppm")),
        "ccs_error_text": F.when(~known, single("ccs_error_pct")),
        "rt_error_text": F.when(~known, single("rt_error")),
    })


def display_table(df: DataFrame, samples: list[str]) -> DataFrame:
    """Isotope summary as shown: short names, rounding, thousands separators, labels and order."""
    shown = round_report(df.withColumn("match", shorten("match", 35)), TABLE_PLACES)
    text = [F.coalesce(F.format_number(F.rint(F.col(f"`{s}`")), 0), F.lit("")).alias(s) for s in sorted(samples)]
    return shown.select(*[F.col(c).alias(label) for c, label in TABLE_LABELS.items() if c in df.columns], *text)


def detail_text(rows: DataFrame, intensity: DataFrame, key: str) -> DataFrame:
    """(key, short_name, detail): class, coordinates, ratio and the samples with a value above 0."""
    per_row = intensity.where("value > 0").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("_seen")
    )
    line = lambda label, c, places, tail="": F.when(
        F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.format_string(f"%.{places}f", F.col(c)), F.lit(tail))
    )
    values = F.transform("_seen", lambda s: F.concat(s["sample"], F.lit(": "), F.format_number(F.rint(s["value"]), 0)))
    listed = F.when(F.size("_seen") > 0, F.array_join(values, "\n")).otherwise("Not detected in any sample")
    ratio = F.when(F.col("ratio").isNotNull(), F.format_string("%.1f", "ratio")).otherwise("out of bounds")
    return rows.join(per_row, key, "left").select(
        key,
        shorten("match", 30).alias("short_name"),
        F.concat_ws(
            "\n", F.concat(F.lit("Classification: "), F.col("class")), line("m/z", "mz", 4), line("CCS", "ccs", 2, " Å²"),
            line("RT", "rt", 2, " min"), F.concat(F.lit("Predicted F/C Ratio: "), ratio), F.lit("--- Intensities (> 0) ---"),
            F.coalesce(listed, F.lit("Not detected in any sample")),
        ).alias("detail"),
    )


def reference_lines(rows: DataFrame, x: str = "m_over_c", points: int = 100) -> DataFrame:
    """(line, n, x, y): the reference lines at evenly spaced points over the range of `x`."""
    span = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo IS NOT NULL")
    lines = F.explode(
        F.array(*[F.struct(F.lit(n).alias("line"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in REFERENCE_LINES.items()])
    ).alias("l")
    at = F.col("lo") + F.col("n") * ((F.col("hi") - F.col("lo")) / F.lit(float(points - 1)))
    return span.select("lo", "hi", lines, F.lit(0).alias("_")).withColumn(
        "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    ).select("l.line", "n", at.alias("x"), (F.col("l.a") * at + F.col("l.b")).alias("y"))


def contour_labels(contours: DataFrame, order: str = "pos") -> DataFrame:
    """Middle row of the first segment of every major level; `order` is the row order in a segment."""
    major = contours.where(F.col("level").isin(MAJOR_LEVELS))
    first = major.groupBy("level").agg(F.min("segment_id").alias("segment_id"))
    segment = major.join(first, ["level", "segment_id"])
    w = Window.partitionBy("level", "segment_id")
    numbered = segment.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return numbered.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def max_of(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias(f"max_{column}"))
