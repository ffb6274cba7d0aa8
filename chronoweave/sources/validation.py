"""Checks of tables; each gives rows of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.names import is_absolute_path
from chronoweave.schemas import TABLES

ISSUES = "severity string, table_name string, message string"
#: Columns that an input package must have.
PACKAGE_REQUIRED = {
    "device_runs": "subject_id run_id device_type start_wallclock_est end_wallclock_est nominal_fps".split(),
    "rgb_samples": "subject_id run_id frame_number pts_sec wallclock_est".split(),
    "radar_pc_samples": "subject_id run_id frame_number observed_wallclock points".split(),
}


def issues(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUES)


def missing_columns(df: DataFrame, required: list[str], name: str) -> list[tuple[str, str, str]]:
    return [("error", name, f"missing required column {c!r}") for c in required if c not in df.columns]


def validate_package(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """A missing table is a warning (an error for device_runs), a missing column an error."""
    rows: list[tuple[str, str, str]] = []
    for name, required in PACKAGE_REQUIRED.items():
        if (df := tables.get(name)) is None:
            rows.append(("error" if name == "device_runs" else "warning", name, "table is missing"))
        else:
            rows += missing_columns(df, required, name)
    return issues(spark, rows)


def null_required(df: DataFrame, required: list[str], name: str) -> DataFrame:
    """table_name, column_name, missing: nulls and empty texts, all columns in one pass."""
    is_text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    bad = lambda c: F.col(c).isNull() | (F.trim(c) == "") if c in is_text else F.col(c).isNull()
    counts = df.agg(*[F.count_if(bad(c)).alias(c) for c in required])
    return counts.unpivot([], required, "column_name", "missing").select(F.lit(name).alias("table_name"), "column_name", "missing")


def duplicate_keys(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """table_name, duplicate_rows: all rows of keys that occur more than once."""
    repeats = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return repeats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows")).select(F.lit(name).alias("table_name"), "duplicate_rows")


def validate_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """All checks of the canonical tables as issues; unknown tables are a warning."""
    out = issues(spark, [])
    for name, df in tables.items():
        if name not in TABLES:
            out = out.unionByName(issues(spark, [("warning", name, "unknown table")]))
            continue
        s = TABLES[name]
        gone = missing_columns(df, s.required, name)
        out = out.unionByName(issues(spark, gone))
        have = [c for c in s.required if c in df.columns]
        nulls = null_required(df, have, name).where("missing > 0")
        out = out.unionByName(nulls.select(F.lit("error").alias("severity"), "table_name", F.concat("missing", F.lit(" rows without "), "column_name").alias("message")))
        if all(c in df.columns for c in s.key):
            double = duplicate_keys(df, s.key, name).where("duplicate_rows > 0")
            out = out.unionByName(double.select(F.lit("error").alias("severity"), "table_name", F.concat(F.col("duplicate_rows").cast("string"), F.lit(" rows share their key")).alias("message")))
    return out


def absolute_path_warnings(assets: DataFrame) -> DataFrame:
    """Assets whose reference looks absolute."""
    return assets.where(is_absolute_path(F.col("asset_ref"))).withColumn("warning", F.lit("asset_ref looks absolute"))
