"""Audit of references and payload files: what the tables promise against what the files hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.names import is_absolute_path
from chronoweave.sources.members import file_states, member_place, read_json_members

SAMPLE = ["subject_id", "run_id", "device_type", "sample_index"]
#: The columns of an audit, the storage that holds payload files, and formats that are opened.
COLUMNS = ("severity", "table", "subject_id", "run_id", "device_type", "sample_index", "artifact_role", "artifact_ref", "issue")
STORAGE, BUNDLE, LINES = "artifact_store", "ragged_npz", "jsonl"


def _found(rows: DataFrame, severity: str, table: str, issue: Column | str) -> DataFrame:
    """Rows of an audit; columns that rows has not are null."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    role = F.col("artifact_role") if "artifact_role" in rows.columns else have("asset_role")
    ref = F.col("artifact_ref") if "artifact_ref" in rows.columns else have("asset_ref")
    keys = [have(c).cast("long" if c == "sample_index" else "string").alias(c) for c in SAMPLE]
    return rows.select(F.lit(severity).alias("severity"), F.lit(table).alias("table"), *keys, role.cast("string").alias("artifact_role"), ref.cast("string").alias("artifact_ref"), (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"))


def _empty(rows: DataFrame, table: str) -> DataFrame:
    """A warning if rows is empty."""
    none = rows.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return _found(none, "warning", table, f"{table} is empty")


def _lost(rows: DataFrame, ref: str, states: DataFrame, table: str) -> DataFrame:
    """Rows whose file is not there; files with a state are few against rows, those without a file fewer."""
    gone = states.where("not there").select(F.col("ref").alias("_ref"))
    bad = rows.withColumn("_r", F.coalesce(ref, F.lit(""))).join(gone, F.col("_r") == F.col("_ref"), "left_semi")
    return _found(bad, "error", table, F.concat(F.lit("file missing: "), F.col("_r")))


def audit(assets: DataFrame, artifacts: DataFrame, summary: DataFrame, root: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """What is wrong with the tables' references and the files behind them, a row for each issue (COLUMNS).

    root: the folder that references lead from; files are looked at and opened on the
    executors, each distinct one once. files: one column `ref`, the files that are known
    to be there, where none can be opened.

    RUN_ASSET: rows of the artifact storage alone; absolute references (warning), missing
    files. SAMPLE_ARTIFACT: missing files; of a ragged bundle what is wrong with its
    offsets and index, told once, at its first sample; of JSON lines each row whose member cannot
    be read at its offset. SAMPLE_SUMMARY: samples with artifacts and no summary
    (warning), where both tables have rows. Empty tables: a warning. A null reference is an
    empty one, and missing.
    """
    if (root is None) == (files is None):
        raise ValueError("give the root of the files, or the files that are known")
    stored = assets.where(F.col("storage_key") == STORAGE) if "storage_key" in assets.columns else assets.limit(0)
    rows = artifacts if "artifact_format" in artifacts.columns else artifacts.withColumn("artifact_format", F.lit(None).cast("string"))
    wanted = rows.select(F.coalesce("artifact_ref", F.lit("")).alias("ref"), F.col("artifact_format").alias("format")).unionByName(stored.select(F.coalesce("asset_ref", F.lit("")).alias("ref"), F.lit(None).cast("string").alias("format")))
    if files is None:
        states = file_states(wanted, root)
    else:
        known = files.select(F.col("ref")).distinct().withColumn("_known", F.lit(True))
        states = wanted.select("ref").distinct().join(known, "ref", "left").select("ref", F.coalesce("_known", F.lit(False)).alias("there"), F.array().cast("array<string>").alias("problems"))
    parts = [
        _empty(assets, "RUN_ASSET"), _found(stored.where(is_absolute_path(F.coalesce("asset_ref", F.lit("")))), "warning", "RUN_ASSET", "asset_ref appears to be an absolute path"), _lost(stored, "asset_ref", states, "RUN_ASSET"),
        _empty(artifacts, "SAMPLE_ARTIFACT"), _lost(rows, "artifact_ref", states, "SAMPLE_ARTIFACT"),
    ]
    if root is not None:
        broken = states.where(F.size("problems") > 0).select("ref", F.explode("problems").alias("issue"))
        first = rows.where(F.col("artifact_format") == BUNDLE).groupBy("artifact_ref").agg(F.min(F.struct(*SAMPLE, "artifact_role")).alias("x"))
        parts.append(_found(first.join(broken, F.col("artifact_ref") == F.col("ref")).select("x.*", "artifact_ref", "issue"), "error", "SAMPLE_ARTIFACT", F.col("issue")))
        lines = rows.where(F.col("artifact_format") == LINES).join(states.where("there").select(F.col("ref").alias("_ref")), F.col("artifact_ref") == F.col("_ref"), "left_semi")
        members = read_json_members(lines.select(*SAMPLE, "artifact_role", "artifact_ref", *member_place("artifact_member_key")), root, "string").where("problem is not null")
        parts.append(_found(members, "error", "SAMPLE_ARTIFACT", F.concat(F.lit("cannot read JSONL member: "), F.col("problem"))))
    bare = artifacts.select(SAMPLE).distinct().join(summary.select(SAMPLE).distinct(), SAMPLE, "left_anti")
    some = summary.limit(1).agg((F.count("*") > 0).alias("_some")).where("_some")  # one row, if there are summaries
    parts.append(_found(bare.join(F.broadcast(some), how="left_semi"), "warning", "SAMPLE_SUMMARY", "sample has artifacts but no SAMPLE_SUMMARY row"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*COLUMNS)
