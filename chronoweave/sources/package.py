"""Input packages, exports and prediction files."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.timelines import first_per_key

#: Files of a package; the first is required.
PACKAGE_TABLES = ("device_runs", "rgb_samples", "radar_pc_samples", "radar_raw_samples", "run_assets")


def read_package(spark: SparkSession, root: str) -> dict[str, DataFrame | None]:
    """The Parquet tables of a package folder; optional ones that are missing are None."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def found(name: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
        return path.getFileSystem(conf).exists(path)

    if not found(PACKAGE_TABLES[0]):
        raise FileNotFoundError(f"{root}/{PACKAGE_TABLES[0]}.parquet")
    return {n: spark.read.parquet(f"{root}/{n}.parquet") if found(n) else None for n in PACKAGE_TABLES}


def import_pickle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A trusted local pandas pickle as a DataFrame; compression by name, else none."""
    try:
        pdf = pd.read_pickle(path)
    except Exception:  # a name may promise a compression that the file has not
        pdf = pd.read_pickle(path, compression=None)
    return spark.createDataFrame(pdf, schema)


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as CSV, and a summary in Markdown on the driver's side."""
    lines = ["# Ingestion report", ""]
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        lines.append(f"- {name}: {df.count()} rows")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/ingestion_report.md", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def prediction_overlay(predictions: DataFrame, joints: int = 17) -> tuple[DataFrame, DataFrame]:
    """One prediction per target sample, the first by row_index, and counts of rows, kept and duplicate ones.

    predictions: row_index, target_sample_index, pose; a pose of another topology is an error.
    """
    shape = F.when((F.size("pose") == joints) & F.forall("pose", lambda j: F.size(j) == 3), F.col("pose")).otherwise(F.raise_error(F.lit(f"poses must have {joints} joints of 3 numbers")))
    rows = predictions.where("target_sample_index is not null").withColumn("pose", shape)
    kept = first_per_key(rows, ["target_sample_index"], ["row_index"])
    counts = rows.agg(F.count("*").alias("rows"), F.countDistinct("target_sample_index").alias("kept")).withColumn("duplicates", F.col("rows") - F.col("kept"))
    return kept, counts
