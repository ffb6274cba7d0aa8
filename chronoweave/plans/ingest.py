"""From an input package to the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.names import asset_id, normalise_asset_ref
from chronoweave.functions.times import finite, micros, parse_datetime
from chronoweave.operators.timelines import first_per_key, fit_lines, fit_report, fitted_times, run_summary, sample_index
from chronoweave.schemas import align, empty_tables
from chronoweave.sources.validation import absolute_path_warnings, validate_package, validate_tables

CAMERA, RADAR = "kinect_rgb", "radar_pc"
RUN = ["subject_id", "run_id"]

#: Id, type and kind of each timeline.
TIMELINES = {
    "rgb_wallclock_from_pts": ("identity_observed", "estimated_wallclock"),
    "rgb_pts_elapsed": ("identity_observed", "pts_based"),
    "rgb_kinect_elapsed_observed": ("identity_observed", "device_elapsed"),
    "rgb_kinect_elapsed_from_pts": ("regressed_from_pts", "device_elapsed"),
    "rgb_smartcup_os_observed": ("identity_observed", "observed_wallclock"),
    "rgb_smartcup_os_from_pts": ("regressed_from_pts", "estimated_wallclock"),
    "radar_pc_observed_wallclock": ("identity_observed", "observed_wallclock"),
    "radar_pc_linear_from_index": ("regressed_observed_vs_index", "latent_acquisition_time"),
}


def _timestamp(df: DataFrame, column: str) -> Column:
    if column not in df.columns:
        return F.lit(None).cast("timestamp")
    return parse_datetime(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("timestamp")


def prepared(samples: DataFrame) -> DataFrame:
    """samples with sample_index: their order of frame_number in each run."""
    return sample_index(samples, RUN, ["frame_number"])


def _times(rows: DataFrame, device: str, timeline: str, moment: Column | None = None, seconds: Column | None = None, reference: Column | None = None, residual: Column | None = None) -> DataFrame:
    none = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return rows.select(
        *RUN, F.lit(device).alias("device_type"), F.lit(timeline).alias("timeline_model_id"), "sample_index", none(moment, "timestamp").alias("time_value_datetime"), none(seconds, "double").alias("time_value_sec"),
        F.lit(TIMELINES[timeline][1]).alias("time_kind"), none(reference, "timestamp").alias("reference_time_datetime"), none(residual, "double").alias("residual_ms"),
    )


def _fitted_seconds(rows: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """A fit of seconds over x, by way of microseconds."""
    based = rows.withColumn("_us", F.bround(finite(F.col(y)) * 1e6).cast("long"))
    fits = fit_lines(based, RUN, x, "_us")
    return fitted_times(based, fits, RUN, x, "_us"), fits


def rgb_timelines(rgb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SAMPLE_TIME_ESTIMATE rows of the camera's timelines, and the fits' report."""
    rows = rgb.withColumns({
        "_wall": _timestamp(rgb, "wallclock_est"), "_pts": finite(F.col("pts_sec").cast("double")), "_os": _timestamp(rgb, "smartcup_os_time"),
        "_elapsed": finite(F.col("kinect_internal_elapsed_sec").cast("double")) if "kinect_internal_elapsed_sec" in rgb.columns else F.lit(None).cast("double"),
    })
    parts = [
        _times(rows, CAMERA, "rgb_wallclock_from_pts", F.col("_wall")),
        _times(rows, CAMERA, "rgb_pts_elapsed", seconds=F.col("_pts"), reference=F.col("_wall")),
        _times(rows.where("_elapsed is not null"), CAMERA, "rgb_kinect_elapsed_observed", seconds=F.col("_elapsed")),
        _times(rows.where("_os is not null"), CAMERA, "rgb_smartcup_os_observed", F.col("_os")),
    ]
    elapsed, elapsed_fits = _fitted_seconds(rows, "_pts", "_elapsed")
    parts.append(_times(elapsed.where("_pts is not null"), CAMERA, "rgb_kinect_elapsed_from_pts", seconds=F.col("fitted_us") / 1e6, residual=F.col("residual_ms")))
    clocked = rows.withColumn("_us", micros(F.col("_os")))
    os_fits = fit_lines(clocked, RUN, "_pts", "_us")
    os_rows = fitted_times(clocked, os_fits, RUN, "_pts", "_us").where("_pts is not null")
    parts.append(_times(os_rows, CAMERA, "rgb_smartcup_os_from_pts", F.timestamp_micros("fitted_us"), reference=F.col("_os"), residual=F.col("residual_ms")))
    reports = [fit_report(f, RUN).withColumn("timeline_model_id", F.lit(n)) for n, f in (("rgb_kinect_elapsed_from_pts", elapsed_fits), ("rgb_smartcup_os_from_pts", os_fits))]
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, reports)


def radar_timelines(radar: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = radar.withColumn("_seen", _timestamp(radar, "observed_wallclock")).withColumn("_us", micros(F.col("_seen")))
    fits = fit_lines(rows, RUN, "sample_index", "_us")
    fitted = fitted_times(rows, fits, RUN, "sample_index", "_us")
    parts = [
        _times(rows.where("_seen is not null"), RADAR, "radar_pc_observed_wallclock", F.col("_seen")),
        _times(fitted, RADAR, "radar_pc_linear_from_index", F.timestamp_micros("fitted_us"), reference=F.col("_seen"), residual=F.col("residual_ms")),
    ]
    return reduce(DataFrame.unionByName, parts), fit_report(fits, RUN).withColumn("timeline_model_id", F.lit("radar_pc_linear_from_index"))


def timeline_models(times: DataFrame, report: DataFrame) -> DataFrame:
    """RUN_TIMELINE_MODEL rows of the timelines that have samples, with the fit's numbers as JSON."""
    kinds = times.sparkSession.createDataFrame([(n, kind) for n, (kind, _) in TIMELINES.items()], "timeline_model_id string, timeline_model_type string")
    fits = report.groupBy(*RUN, "timeline_model_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("parameters_json"))
    found = times.select(*RUN, "device_type", "timeline_model_id").distinct().join(F.broadcast(kinds), "timeline_model_id")  # eight rows
    return found.join(fits, [*RUN, "timeline_model_id"], "left").withColumn("timeline_model_name", F.col("timeline_model_id"))


def _runs(samples: DataFrame, device: str) -> DataFrame:
    kind = F.coalesce(F.col("sample_kind"), F.lit("frame")) if "sample_kind" in samples.columns else F.lit("frame")
    return samples.select(*RUN, F.lit(device).alias("device_type"), "sample_index", kind.alias("sample_kind"), F.concat(F.lit("source_frame_number="), F.col("frame_number").cast("string")).alias("notes"))


def video_assets(rgb: DataFrame) -> DataFrame:
    """RUN_ASSET rows: one per run's video, with the number of its frames."""
    if "video_ref" not in rgb.columns:
        return rgb.sparkSession.createDataFrame([], "asset_id string, subject_id string, run_id string, device_type string, asset_role string, asset_ref string, notes string")
    counted = rgb.groupBy(*RUN, "video_ref").agg(F.count("*").alias("n"))
    device = F.lit(CAMERA)
    rows = counted.select(asset_id(F.col("subject_id"), F.col("run_id"), device, F.lit("rgb_video")).alias("asset_id"), *RUN, device.alias("device_type"), F.lit("rgb_video").alias("asset_role"), F.lit("default").alias("storage_key"), normalise_asset_ref(F.col("video_ref")).alias("asset_ref"), F.concat(F.lit("num_samples="), F.col("n").cast("string")).alias("notes"))
    return first_per_key(rows, ["asset_id"], ["asset_ref"])


def transform(spark: SparkSession, package: dict[str, DataFrame | None]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The canonical tables and the reports of a package; an invalid package is an error."""
    checked = validate_package(spark, package)
    if wrong := checked.where("severity = 'error'").limit(20).collect():
        raise ValueError("; ".join(f"{r['table_name']}: {r['message']}" for r in wrong))
    tables = empty_tables(spark)
    runs = package["device_runs"]
    runs = runs.withColumns({c: _timestamp(runs, c) for c in ("start_wallclock_est", "end_wallclock_est")})
    tables["DEVICE_RUN"] = align("DEVICE_RUN", first_per_key(runs, [*RUN, "device_type"], ["start_wallclock_est", "end_wallclock_est"]))
    samples, times, reports = [], [], []
    if (rgb := package.get("rgb_samples")) is not None:
        rgb = prepared(rgb)
        t, r = rgb_timelines(rgb)
        samples, times, reports = [*samples, _runs(rgb, CAMERA)], [*times, t], [*reports, r]
        tables["RUN_ASSET"] = align("RUN_ASSET", video_assets(rgb))
    if (radar := package.get("radar_pc_samples")) is not None:
        radar = prepared(radar)
        t, r = radar_timelines(radar)
        samples, times, reports = [*samples, _runs(radar, RADAR)], [*times, t], [*reports, r]
    extra: dict[str, DataFrame] = {"package_issues": checked}
    if samples:
        fits = reduce(DataFrame.unionByName, reports)
        every = reduce(DataFrame.unionByName, times)
        tables["RUN_SAMPLE"] = align("RUN_SAMPLE", reduce(DataFrame.unionByName, samples))
        tables["SAMPLE_TIME_ESTIMATE"] = align("SAMPLE_TIME_ESTIMATE", every)
        tables["RUN_TIMELINE_MODEL"] = align("RUN_TIMELINE_MODEL", timeline_models(every, fits))
        extra["timeline_fit"] = fits
    subjects = tables["DEVICE_RUN"].select("subject_id").unionByName(tables["RUN_SAMPLE"].select("subject_id")).distinct()
    tables["SUBJECT"] = align("SUBJECT", subjects)
    extra["table_issues"] = validate_tables(spark, tables)
    extra["device_run_summary"] = run_summary(tables["DEVICE_RUN"], tables["RUN_SAMPLE"].select(*RUN, "device_type"), [*RUN, "device_type"])
    extra["asset_path_warnings"] = absolute_path_warnings(tables["RUN_ASSET"])
    return tables, extra


def ingest(store, package: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """Replaces the whole store by a package; returns the reports."""
    tables, reports = transform(store.spark, package)
    with store.transaction() as t:
        t.initialise_empty()
        for name, df in tables.items():
            t.write(name, df)
    return reports


