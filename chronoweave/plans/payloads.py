"""Payload tables, summaries and inspection of mapped pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.names import artifact_ref, slugify
from chronoweave.plans.ingest import CAMERA, RADAR, prepared
from chronoweave.sources.payloads import TAILS, checked_payload

SAMPLE = ["subject_id", "run_id", "device_type", "sample_index"]


def _size(df: DataFrame, column: str):
    return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).cast("long") if column in df.columns else F.lit(0).cast("long")


def _number(df: DataFrame, column: str, default):
    return F.coalesce(F.col(column).try_cast("long"), default) if column in df.columns else default


def payload_rows(samples: DataFrame, device: str, roles: dict[str, str]) -> DataFrame:
    """SAMPLE keys, artifact_role, n_rows, payload (JSON): one row per sample and role.

    roles: payload column by role. Shapes are checked; a wrong one fails the job.
    """
    rows = prepared(samples).withColumn("device_type", F.lit(device))
    entry = lambda role, column: F.struct(F.lit(role).alias("artifact_role"), _size(rows, column).alias("n_rows"), F.to_json(checked_payload(F.col(column), TAILS[role], role) if role in TAILS else F.col(column)).alias("payload"))
    have = [entry(r, c) for r, c in roles.items() if c in rows.columns]
    return rows.select(*SAMPLE, F.explode(F.array(*have)).alias("e")).select(*SAMPLE, "e.*")


def camera_payloads(rgb: DataFrame) -> DataFrame:
    return payload_rows(rgb, CAMERA, {"pose2d": "pose2d", "conf2d": "conf2d", "pose3d": "pose3d", "activity": "activity"})


def radar_payloads(radar: DataFrame) -> DataFrame:
    return payload_rows(radar, RADAR, {"radar_points": "points"})


def artifacts(payloads: DataFrame) -> DataFrame:
    """SAMPLE_ARTIFACT rows of payload rows."""
    file = F.concat("artifact_role", F.lit(".parquet"))
    shape = lambda tail: F.concat(F.lit("["), F.col("n_rows").cast("string"), F.lit("".join(f",{n}" for n in tail)), F.lit("]"))
    shapes = reduce(lambda w, r: w.when(F.col("artifact_role") == r, shape(TAILS[r])), TAILS, F.when(F.lit(False), "")).otherwise(shape(()))
    return payloads.select(
        *SAMPLE, "artifact_role", F.concat_ws("_", *[slugify(F.col(c)) for c in SAMPLE], "artifact_role").alias("artifact_id"), F.lit("default").alias("storage_key"),
        artifact_ref(F.col("subject_id"), F.col("device_type"), F.col("run_id"), file).alias("artifact_ref"), F.to_json(F.struct("sample_index")).alias("artifact_member_key"), F.lit("parquet").alias("artifact_format"),
        shapes.alias("payload_shape"), F.lit("float64").alias("payload_dtype"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.current_timestamp().alias("created_at"),
    )


def camera_summary(rgb: DataFrame) -> DataFrame:
    rows = prepared(rgb)
    has = {f"has_{c}": _size(rows, c) > 0 for c in ("pose2d", "conf2d", "pose3d")}
    zero = F.lit(0).cast("long")
    return rows.select(
        *SAMPLE[:2], F.lit(CAMERA).alias("device_type"), "sample_index", *[_number(rows, c, d).alias(c) for c, d in (("num_people", zero), ("num_2d", _size(rows, "pose2d")), ("num_3d", _size(rows, "pose3d")))],
        *[c.alias(n) for n, c in has.items()], F.lit("activity" in rows.columns).alias("has_activity"), F.lit(False).alias("has_points"),
    )


def radar_summary(radar: DataFrame) -> DataFrame:
    rows = prepared(radar)
    return rows.select(*SAMPLE[:2], F.lit(RADAR).alias("device_type"), "sample_index", _number(rows, "point_count", _size(rows, "points")).alias("point_count"), _number(rows, "point_count_filtered", F.lit(0).cast("long")).alias("point_count_filtered"), (_size(rows, "points") > 0).alias("has_points"))


def build_artifacts(store, path: str, rgb: DataFrame | None, radar: DataFrame | None, overwrite: bool = False) -> None:
    """Writes the payload table (partitioned by device and role) and upserts its manifest and summaries."""
    parts = [f(df) for f, df in ((camera_payloads, rgb), (radar_payloads, radar)) if df is not None]
    every = reduce(DataFrame.unionByName, parts)
    every.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("device_type", "artifact_role").parquet(path)
    written = read_payloads(store.spark, path)
    with store.transaction() as t:
        t.upsert("SAMPLE_ARTIFACT", artifacts(written))
        for f, df in ((camera_summary, rgb), (radar_summary, radar)):
            if df is not None:
                t.upsert("SAMPLE_SUMMARY", f(df))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject_id string, run_id string, sample_index long, n_rows long, payload string, device_type string, artifact_role string").parquet(path)


def mapped_pair(mapping: DataFrame, payloads: DataFrame, summary: DataFrame, version: str, source_index: int) -> DataFrame:
    """source and target rows (side, SAMPLE, artifact_role, n_rows, payload, summary) of one mapped source sample.

    Its primary rows if there are any, else all; of these the smallest rank.
    """
    rows = mapping.where((F.col("mapping_version_id") == version) & (F.col("source_sample_index") == source_index))
    best = rows.orderBy(F.desc("is_primary"), "rank", F.abs("predicted_minus_estimated_ms"), "target_sample_index").limit(1)
    sides = [best.select(F.lit(p).alias("side"), "subject_id", *[F.col(f"{p}_{c}").alias(c) for c in SAMPLE[1:]]) for p in ("source", "target")]
    info = summary.select(*SAMPLE, F.to_json(F.struct(*[c for c in summary.columns if c not in SAMPLE])).alias("summary"))
    wanted = sides[0].unionByName(sides[1])
    return wanted.join(payloads, SAMPLE, "left").join(info, SAMPLE, "left")


def with_num_people(mapping: DataFrame, summary: DataFrame) -> DataFrame:
    """mapping with the source sample's num_people; a summary with repeated keys is an error."""
    if not summary.groupBy(SAMPLE).count().where("count > 1").limit(1).isEmpty():
        raise ValueError("summaries repeat for a sample")
    s = summary.select("subject_id", *[F.col(c).alias(f"source_{c}") for c in SAMPLE[1:]], "num_people")
    return mapping.join(s, ["subject_id", *[f"source_{c}" for c in SAMPLE[1:]]], "left")


def single_person_rows(mapping: DataFrame, versions: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary rows of the chosen versions with exactly one person, and the counts of what was left out."""
    primary = mapping.join(versions.select("subject_id", "mapping_version_id", "mapping_method"), ["subject_id", "mapping_version_id"]).where("is_primary")
    rows = with_num_people(primary, summary)
    n = F.col("num_people")
    counts = rows.agg(F.count("*").alias("primary_rows"), F.count_if(n == 1).alias("single_person"), F.count_if(n == 0).alias("no_person"), F.count_if(n > 1).alias("several_people"), F.count_if(n.isNull()).alias("without_summary"))
    return rows.where(n == 1), counts


def target_fps(rows: DataFrame, runs: DataFrame, override: float | None = None) -> DataFrame:
    """target_fps of each target run: the override, or its one positive nominal rate; else an error."""
    key = ["subject_id", "run_id", "device_type"]
    wanted = rows.select("subject_id", F.col("target_run_id").alias("run_id"), F.col("target_device_type").alias("device_type")).distinct()
    if override:
        return wanted.withColumn("target_fps", F.lit(float(override)))
    rates = wanted.join(runs.where("nominal_fps > 0").groupBy(key).agg(F.collect_set("nominal_fps").alias("r")), key, "left")
    if not rates.where("r is null or size(r) <> 1").limit(1).isEmpty():
        raise ValueError("a target run has no single positive nominal rate")
    return rates.select(*key, F.element_at("r", 1).alias("target_fps"))
