"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back.

    Cuts the lineage, so that a plan that uses df several times stays small; the rows
    survive lost executors. A local session without the setting has a local default.
    """
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(named or 'file:///tmp/checkpoints/chronoweave').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
