"""Ragged array payloads and JSON lines: one row per sample, with offsets where a file needs them."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.scan import scan, slice_of

#: Shape of a payload's rows by role.
TAILS = {"pose2d": (26, 3), "conf2d": (), "pose3d": (32, 4), "radar_points": (6,)}


def checked_payload(values, tail: tuple[int, ...], name: str):
    """values, or an error where a row's shape is not tail; null counts as no rows."""
    def fits(x, shape):
        return F.lit(True) if not shape else (F.size(x) == shape[0]) & (F.forall(x, lambda y: fits(y, shape[1:])) if shape[1:] else F.lit(True))

    ok = F.forall(values, lambda row: fits(row, tail))
    return F.when(values.isNull() | ok, values).otherwise(F.raise_error(F.lit(f"{name}: rows must have shape {tail}")))


def ragged_index(rows: DataFrame, run: list[str], values: str = "values", index: str = "sample_index") -> DataFrame:
    """rows with begin and end of their values in the run's concatenation, in order of index."""
    n = F.coalesce(F.size(values), F.lit(0)).cast("long")
    n = F.when(n < 0, 0).otherwise(n)
    return scan(rows, run, slice_of(rows, index), [index], sums={"end": n}).withColumn("begin", F.col("end") - n)


def ragged_issues(bundle: DataFrame, run: list[str], total: DataFrame | None = None, index: str = "sample_index") -> DataFrame:
    """run, issue: what is wrong with a bundle's offsets (begin, end per sample).

    Five checks: first offset 0, offsets rising, no gaps, no repeated index, and where
    total (run, n_values) is given, the last offset.
    """
    w = W.partitionBy(run).orderBy(index, "begin")
    rows = bundle.withColumns({"_prev": F.lag("end").over(w), "_same": F.lag(index).over(w) == F.col(index), "_k": F.row_number().over(w)})
    found = rows.groupBy(run).agg(
        F.bool_or((F.col("_k") == 1) & (F.col("begin") != 0)).alias("first offset is not 0"),
        F.bool_or(F.col("end") < F.col("begin")).alias("offsets fall"),
        F.bool_or(F.col("_prev") != F.col("begin")).alias("offsets do not meet"),
        F.bool_or("_same").alias("sample index repeats"),
        F.max("end").alias("_end"),
    )
    names = [c for c in found.columns if c not in run and c != "_end"]
    if total is not None:
        found = found.join(total, run, "left").withColumn("last offset is not the number of values", F.col("_end") != F.col("n_values"))
        names.append("last offset is not the number of values")
    return found.unpivot(run, names, "issue", "bad").where("bad").drop("bad")


def payload_of(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """The rows of one sample: a filter that reaches the Parquet scan."""
    for c, v in filters.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows


def payload_map(rows: DataFrame, key: list[str], role: str = "artifact_role", payload: str = "payload") -> DataFrame:
    """key, payloads: a map from role to payload."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(role, payload)))).alias("payloads"))


def json_lines(rows: DataFrame, run: list[str], payload: str = "payload", index: str = "sample_index") -> DataFrame:
    """One compact JSON line per sample, keys sorted, with its byte offset and length in the run's file."""
    line = F.to_json(F.struct(F.col(payload).alias("payload"), F.col(index).alias("sample_index")), {"ignoreNullFields": "false"})
    out = rows.withColumn("line", line).withColumn("nbytes", F.octet_length("line").cast("long"))
    out = scan(out, run, slice_of(rows, index), [index], sums={"_upto": F.col("nbytes") + 1}, of=[rows])
    return out.withColumn("offset", F.col("_upto") - F.col("nbytes") - 1).drop("_upto")


def read_json_lines(spark, path: str, payload_type: str) -> DataFrame:
    """sample_index, payload of whole JSON-lines files; members.read_json_members reads single lines by their offsets."""
    return spark.read.schema(f"payload {payload_type}, sample_index long").json(path)


def npz_bundles(rows: DataFrame, run: list[str], values: str = "values", index: str = "sample_index") -> DataFrame:
    """run, data: a compressed npz of sample_index, offsets, values for each run (array rows of one width).

    An export for tools that read such files; a run's bundle has to fit in a task.
    """
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in run), "data binary"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        parts = [np.array([np.asarray(r, float) for r in v], float) if v is not None and len(v) else None for v in pdf[values]]
        counts = [0 if p is None else len(p) for p in parts]
        held = [p for p in parts if p is not None]
        out = io.BytesIO()
        np.savez_compressed(out, sample_index=pdf[index].to_numpy(np.int64), offsets=np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), values=np.concatenate(held) if held else np.empty((0,)))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in run), out.getvalue()]], columns=[*run, "data"])

    return rows.select(*run, index, values).groupBy(run).applyInPandas(pack, schema)
