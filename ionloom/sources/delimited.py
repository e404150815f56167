"""Delimited feature lists and libraries: reading, column mapping, long form."""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.functions.numeric import to_double
from ionloom.model import DEFAULT_REPEAT_UNITS, LIBRARY_L5, STANDARD


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of every file under `paths`, by file, in one job.

    Files are not split and not put together for this scan, so each is a task of its own that stops after its first batch of lines.
    """
    whole = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.openCostInBytes": str(1 << 60), "spark.sql.files.minPartitionNum": "1"}
    before = {key: spark.conf.get(key, None) for key in whole}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    try:
        for key, value in whole.items():
            spark.conf.set(key, value)
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
        found = lines.mapInArrow(first, "file string, value string").collect()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return {unquote(file): line.lstrip("\ufeff") for file, line in found}


def detect_separator(header: str) -> str:
    """Tab or comma, whichever the header line has more of."""
    return "\t" if header.count("\t") > header.count(",") else ","


def _layouts(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One scan per distinct header, in the order in which the paths bring them, with `source_file`."""
    if not paths:
        raise ValueError("no input files")

    def place(file: str) -> tuple[int, str]:
        return next((i for i, p in enumerate(paths) if p.split("://")[-1].rstrip("/") in file), len(paths)), file

    headers = _headers(spark, paths)
    layouts: dict[tuple[str, str], list[str]] = {}
    for file in sorted(headers, key=place):
        layouts.setdefault((detect_separator(headers[file]), headers[file]), []).append(file)
    if not layouts:
        raise ValueError(f"no header line in {', '.join(paths)}")
    frames = []
    for (sep, header), files in layouts.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _column_names(header, sep)])
        own = paths if len(layouts) == 1 else [_literal(file) for file in files]
        frame = spark.read.schema(schema).csv(own, header=True, sep=sep, enforceSchema=True)
        frames.append(frame.withColumn("source_file", F.input_file_name()))
    return frames


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All rows of the files by column name, text typed, with `source_file`.

    The separator is taken from each header line; the headers of all files are read in one job. Files that share header and
    separator are one scan, in which the header is the schema, so Spark does not look into them again before it runs.
    Repeated header names get their position appended, as positions are what columns are mapped by.
    """
    return _stacked(_layouts(spark, [paths] if isinstance(paths, str) else list(paths)))


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _column_names(header: str, sep: str) -> list[str]:
    """Trimmed names of a header line; an empty one is named by its position, repeated ones get it appended."""
    names = [name.strip() for name in next(csv.reader([header], delimiter=sep))]
    seen = Counter(name.lower() for name in names)
    return [f"_c{i}" if not name else f"{name}{i}" if seen[name.lower()] > 1 else name for i, name in enumerate(names)]


def _literal(path: str) -> str:
    """A path whose special characters are no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def select_dotted(df: DataFrame, marker: str = ".d", lead: int = 5) -> DataFrame:
    """The first `lead` columns and every later one whose name holds the marker."""
    names = [c for c in df.columns if c != "source_file"]
    kept = names[:lead] + [c for c in names[lead:] if marker in c]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def combine_dotted(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _stacked([select_dotted(frame) for frame in _layouts(spark, list(paths))])


def column_index(letters: str) -> int:
    """Zero-based position of a spreadsheet column: A is 0, Z is 25, AA is 26."""
    letters = (letters or "").strip().upper()
    if not letters or not all("A" <= ch <= "Z" for ch in letters):
        raise ValueError(f"not a column letter: {letters!r}")
    position = 0
    for ch in letters:
        position = position * 26 + ord(ch) - ord("A") + 1
    return position - 1


def map_columns(
    df: DataFrame, mapping: dict[str, str], strict: bool = False, allow_names: bool = False
) -> DataFrame:
    """Renames columns, given as canonical name -> column letter (or, if allowed, header name).

    Letters past the last column are skipped, or raise when `strict`. With names allowed a single
    letter is a position, anything else a header name that must exist, and blanks are skipped.
    """
    names = list(df.columns)
    renamed: dict[int, str] = {}
    for canonical, where in mapping.items():
        if allow_names and not where:
            continue
        if allow_names and not (len(where) == 1 and where.isalpha()):
            if where not in names:
                raise ValueError(f"column {where!r} not found; there are {names}")
            index = names.index(where)
        else:
            index = column_index(where)
            if index >= len(names):
                if strict or allow_names:
                    raise ValueError(f"column {where} is out of range; there are {len(names)}")
                continue
        renamed[index] = canonical
    taken = set(renamed.values())
    return df.select(
        *[
            F.col(f"`{c}`").alias(renamed.get(i, f"{c} ({i})" if c in taken else c))
            for i, c in enumerate(names)
        ]
    )


def split_roles(
    columns: list[str], blanks: tuple[str, str], experimental: tuple[str, str]
) -> tuple[list[str], list[str], list[str]]:
    """(blank, experimental, metadata) column names from two inclusive letter ranges."""

    def span(letters: tuple[str, str]) -> list[str]:
        lo, hi = (column_index(x) for x in letters)
        if lo >= len(columns) or hi >= len(columns):
            raise ValueError(f"columns {letters} are out of range; there are {len(columns)}")
        return columns[lo : hi + 1]

    blank, exp = span(blanks), span(experimental)
    return blank, exp, [c for c in columns if c not in set(blank) | set(exp)]


def split_roles_by_name(
    columns: list[str], blanks: list[str], experimental: list[str], lead: int = 5
) -> tuple[list[str], list[str], list[str]]:
    """Same from explicit names; the first `lead` columns are metadata. Unknown names raise."""
    missing = [c for c in [*blanks, *experimental] if c not in columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return list(blanks), list(experimental), columns[:lead]


def to_long(
    df: DataFrame, blank: list[str], experimental: list[str], id_column: str = "feature_id"
) -> tuple[DataFrame, DataFrame]:
    """Feature and intensity frames from a wide one that has the canonical coordinate columns.

    Other columns go to the map `meta`. NaN and unreadable numbers become NULL here, once.
    """
    canonical = [id_column, "mz", "rt", "dt", "ccs"]
    other = [c for c in df.columns if c not in set(canonical) | set(blank) | set(experimental) | {"source_file"}]
    whole = F.col(id_column).try_cast("bigint")  # the double form is only for texts like 1.0: it cannot hold every id
    identity = F.coalesce(whole, F.col(id_column).try_cast("double").cast("long")).alias("feature_id")
    coords = [(to_double(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in canonical[1:]]
    meta = F.map_from_arrays(
        F.array(*[F.lit(c) for c in other]).cast("array<string>"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in other]).cast("array<string>"),
    ).alias("meta")
    features = df.select(identity, *coords, meta, *(["source_file"] if "source_file" in df.columns else []))
    values = df.select(identity, *[to_double(F.col(f"`{c}`")).alias(c.replace(".", "\u0001")) for c in [*blank, *experimental]])
    long = values.unpivot("feature_id", [c for c in values.columns if c != "feature_id"], "sample", "value")
    long = long.withColumn("sample", F.translate("sample", "\u0001", "."))
    role = F.when(F.col("sample").isin(blank), "blank").otherwise("exp")
    return features, long.select("feature_id", "sample", role.alias("role"), "value")


def require_unique_ids(features: DataFrame, id_column: str = "feature_id") -> DataFrame:
    """`features` unchanged, or an error if an id is missing or occurs twice, as in stacked files; joins would multiply such rows."""
    twice = features.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where(F.col(id_column).isNull() | (F.col("n") > 1)).first()
    if twice:
        raise ValueError(f"{id_column} {twice[0]} occurs {twice[1]} times" if twice[0] is not None else f"{twice[1]} rows without {id_column}")
    return features


def to_wide(features: DataFrame, intensity: DataFrame, samples: list[str]) -> DataFrame:
    """One column per sample next to the features; for report sinks."""
    wide = intensity.groupBy("feature_id").pivot("sample", samples).agg(F.max("value"))
    return features.join(wide, "feature_id", "left")


def read_library(spark: SparkSession, path: str, mapping: dict[str, str], id_name: str = "lib_id") -> DataFrame:
    """A library with canonical columns, doubles parsed, exact duplicates dropped, and a stable id."""
    raw = map_columns(read_delimited(spark, path).drop("source_file"), mapping)
    numeric = [c for c in ("mz", "ccs", "rt") if c in mapping and c in raw.columns]
    text = [c for c in mapping if c in raw.columns and c not in numeric]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]).alias(id_name)
    return raw.distinct().select(key, *text, *[to_double(c).alias(c) for c in numeric])


def read_level2(spark: SparkSession, path: str | None, mapping: dict[str, str]) -> DataFrame:
    if not path:
        raise ValueError("the level-2 library is required")
    return read_library(spark, path, mapping)


def read_level5(spark: SparkSession, path: str | None, mapping: dict[str, str]) -> DataFrame:
    return read_library(spark, path, mapping) if path else spark.createDataFrame([], LIBRARY_L5)


def read_standards(spark: SparkSession, path: str | None, mapping: dict[str, str], ignore: bool = False) -> DataFrame:
    """Standards, or an empty table when they are ignored, not given or not readable."""
    empty = spark.createDataFrame([], STANDARD)
    if ignore or not path:
        return empty
    try:
        read_delimited(spark, path)
    except (AnalysisException, ValueError) as error:  # an unreadable optional file is the same as none; a wrong mapping is not
        print(f"standards not read: {error}")
        return empty
    return read_library(spark, path, mapping, "std_id")


def read_repeat_units(spark: SparkSession, path: str | None) -> dict[str, float]:
    """Name -> mass from {"repeating_units": {...}}; CF2 alone without a file."""
    if not path:
        return dict(DEFAULT_REPEAT_UNITS)
    try:
        text = spark.read.text(path, wholetext=True).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return dict(DEFAULT_REPEAT_UNITS)
    return {k: float(v) for k, v in json.loads(text).get("repeating_units", DEFAULT_REPEAT_UNITS).items()}


def harmonise(df: DataFrame, library: bool) -> DataFrame:
    """Missing id (0 for a library, an error otherwise) and retention time (NULL)."""
    if "id" not in df.columns:
        if not library:
            raise ValueError("an id column must be given for the experimental file")
        df = df.withColumn("id", F.lit(0).cast(T.LongType()))
    return df if "rt" in df.columns else df.withColumn("rt", F.lit(None).cast("double"))


def write_report(df: DataFrame, path: str, single_file: bool = False, order: list[str | Column] | None = None) -> None:
    """Overwrites a CSV folder with a header.

    With `order` the report is sorted without passing through one task: rows are range-partitioned on these columns, each
    partition is sorted and written as a file, and `<path>.manifest` (JSON) lists the files in order with their numbers of rows. Read one
    after the other they are the sorted report; `read_report` does so. `single_file` is for reports that fit in one task.
    """
    if order is None:
        (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)
        return
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
    spark = df.sparkSession
    parts = spark.read.schema(T.StructType([T.StructField("first", T.StringType())])).csv(path, header=True)
    # Spark names part files by the number of their partition, which is their place in the order.
    files = parts.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    files.coalesce(1).sortWithinPartitions(_part_number("file")).write.mode("overwrite").json(f"{path}.manifest")


def _part_number(file: str) -> Column:
    return F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a report written with `order`, all texts, with _part and _row: their place in the sorted report."""
    manifest = spark.read.schema("file string, rows long").json(f"{path}.manifest")
    places = manifest.select("file", (F.row_number().over(Window.orderBy(_part_number("file"))) - 1).alias("_part"))  # one row per file
    rows = spark.read.csv(path, header=True)
    # A file is read from its start when it is one split; splits of a larger one follow each other by their offset.
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    return rows.join(F.broadcast(places), "file").withColumn("_row", F.struct("_start", "_id")).drop("file", "_start", "_id")


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
