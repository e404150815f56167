"""Schemas, default parameters and fixed chemical values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

FEATURE = T.StructType(
    [
        T.StructField("feature_id", T.LongType()),
        T.StructField("mz", T.DoubleType()),
        T.StructField("rt", T.DoubleType()),
        T.StructField("dt", T.DoubleType()),
        T.StructField("ccs", T.DoubleType()),
    ]
)
INTENSITY = T.StructType(
    [
        T.StructField("feature_id", T.LongType()),
        T.StructField("sample", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
LIBRARY_L2 = T.StructType(
    [
        T.StructField("lib_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("adduct", T.StringType()),
        T.StructField("mz", T.DoubleType()),
        T.StructField("ccs", T.DoubleType()),
        T.StructField("rt", T.DoubleType()),
    ]
)
LIBRARY_L5 = T.StructType(
    [
        T.StructField("lib_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("mz", T.DoubleType()),
    ]
)
STANDARD = T.StructType(
    [
        T.StructField("std_id", T.LongType()),
        T.StructField("mz", T.DoubleType()),
        T.StructField("ccs", T.DoubleType()),
    ]
)

# Exact masses and offsets in Dalton.
MASS_C = 12.0
MASS_F = 18.9984032
OFFSET_H = 1.007825
OFFSET_NA = 21.981945
OFFSET_NH4 = 17.0265478

# Adduct and multimer rules, target = a * mz + b.
ADDUCT_RULES = [
    ("2M+H", 2.0, OFFSET_H),
    ("3M+2H", 3.0, 2 * OFFSET_H),
    ("M+Na-H", 1.0, OFFSET_NA - OFFSET_H),
    ("M+NH4-H", 1.0, OFFSET_NH4 - OFFSET_H),
    ("2M+Na", 2.0, OFFSET_NA),
    ("3M+2NH4", 3.0, 2 * OFFSET_NH4),
    ("3M+2Na", 3.0, 2 * OFFSET_NA),
    ("2M+NH4", 2.0, OFFSET_NH4),
    ("3M+Na+NH4", 3.0, OFFSET_NA + OFFSET_NH4),
    ("3M+H+NH4", 3.0, OFFSET_H + OFFSET_NH4),
    ("3M+H+Na", 3.0, OFFSET_H + OFFSET_NA),
]

# Neutral losses in Dalton.
NEUTRAL_LOSSES = [
    ("M-CO2", 43.9898),
    ("M-CO", 27.9949),
    ("M-SO3", 79.9568),
    ("M-H2CO", 30.0106),
    ("M-H3PO4", 97.9769),
    ("M-FSO3", 98.9552),
]

# Repeating units in Dalton.
REPEAT_UNITS = {
    "CF2": 49.9968,
    "OCF2": 65.9917,
    "C2F4": 99.9936,
    "CFH": 31.0096,
    "CH2": 14.0156,
    "C2F3Cl": 115.9641,
    "OC3F6": 165.9853,
    "OC2F4": 115.9885,
}
DEFAULT_REPEAT_UNITS = {"CF2": 49.9968}

# Kendrick factors, nominal over exact mass of the unit.
KENDRICK_FACTORS = {"cf2": 50 / 49.99681, "ocf2": 66 / 65.99172}

# Mass-defect windows.
MASS_DEFECT_PRESETS = {
    "narrow": (-0.075, 0.102),
    "wide": (-0.194, 0.09),
    "default": (-0.12, 0.11),
}

CLASS_LIKELY = "likely"
CLASS_TENTATIVE = "tentative"
CLASS_UNMATCHED = "unmatched"
CLASS_STANDARD = "External Standard"


@dataclass(frozen=True)
class Params:
    """Settings of the screening, series and isotope plans, with their usual starting values."""

    ppm: float = 15.0
    ccs_pct: float = 2.0
    rt_tol: float = 0.5
    rt_scoring: bool = False
    min_intensity: float = 100.0
    rt_min: float = 0.5
    rt_max: float = 16.0
    mz_min: float = 100.0
    mz_max: float = 2000.0
    frequency_pct: float = 15.0
    mass_defect_lo: float = MASS_DEFECT_PRESETS["default"][0]
    mass_defect_hi: float = MASS_DEFECT_PRESETS["default"][1]
    blank_method: str = "2"
    blank_sds: float = 3.0
    duplicate_cap_ppm: float = 20.0
    rt_band: bool = False
    ccs_band: bool = True
    remove_standards: bool = True
    # The last isotope step reads its cross-section tolerance as a fraction, so the percent
    # value makes it accept any pair; kept because results follow from it.
    m2_ccs_fraction: float = 2.0
    series_min_points: int = 3
    series_min_library: int = 0
    trend_residual_fraction: float = 0.02
    trend_trials: int = 200
    slope_lo: float = 0.05
    slope_hi: float = 0.25
    isotope_ppm: float = 10.0
    isotope_ccs_pct: float = 2.0
    isotope_rt_tol: float = 1.0
