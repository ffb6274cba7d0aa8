"""Versioned mappings: one pair, all overlapping pairs, through fitted clock models."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.names import version_id
from chronoweave.functions.times import micros, timeline_values
from chronoweave.operators import piecewise as pw
from chronoweave.operators.nearest import NearestConfig, mapping_diagnostics, nearest_mapping
from chronoweave.operators.timelines import coverage, overlap_pairs

TIMELINE = ["subject_id", "run_id", "device_type", "timeline_model_id"]


@dataclass(frozen=True)
class Timeline:
    subject_id: str
    run_id: str
    device_type: str
    timeline_model_id: str


def timeline_times(times: DataFrame) -> DataFrame:
    """Timeline keys, sample_index, t (microseconds) and time_basis of SAMPLE_TIME_ESTIMATE rows."""
    out = timeline_values(times, TIMELINE)
    exact = F.when(F.col("time_basis") == "datetime", micros(F.col("time_value_datetime"))).otherwise(F.bround(F.col("t") * 1e6).cast("long"))
    return out.select(*TIMELINE, "sample_index", exact.alias("t"), "time_basis")


def select(times: DataFrame, timeline: Timeline) -> DataFrame:
    for c, v in asdict(timeline).items():
        times = times.where(F.col(c) == v)
    return times


def _basis(times: DataFrame) -> str:
    found = times.select("time_basis").limit(1).collect()
    return found[0][0] if found else "missing"


def sample_mapping(labelled: DataFrame, subject: str, version: str, source: Timeline, target: Timeline, region: str = "mapping_region_type") -> DataFrame:
    """Labelled matches as SAMPLE_MAPPING rows."""
    return labelled.select(
        F.lit(subject).alias("subject_id"), F.lit(version).alias("mapping_version_id"), F.lit(source.run_id).alias("source_run_id"), F.lit(source.device_type).alias("source_device_type"), "source_sample_index",
        F.lit(target.run_id).alias("target_run_id"), F.lit(target.device_type).alias("target_device_type"), "target_sample_index", F.col("delta_ms").alias("predicted_minus_estimated_ms"), "rank", "is_primary",
        F.col(region).alias("mapping_region_type"), "support_status", "confidence_score",
    )


class MappingService:
    def __init__(self, store):
        self.store, self.spark = store, store.spark

    def _times(self) -> DataFrame:
        return timeline_times(self.store.read("SAMPLE_TIME_ESTIMATE"))

    def _guard(self, subject: str, version: str, overwrite: bool) -> None:
        if not overwrite and self.store.row_exists("MAPPING_VERSION", {"subject_id": subject, "mapping_version_id": version}):
            raise ValueError(f"mapping version {version!r} already exists")

    def _save(self, subject: str, version: str, model_id: str, model: DataFrame, version_row: DataFrame, mapping: DataFrame, anchors: DataFrame | None = None) -> None:
        """A version with its model and rows, in place of what it held before: all of it or nothing."""
        with self.store.transaction() as t:
            t.delete_where("SAMPLE_MAPPING", {"subject_id": subject, "mapping_version_id": version})
            t.upsert("SYNC_MODEL", model)
            if anchors is not None:
                t.delete_where("MODEL_ANCHOR", {"subject_id": subject, "sync_model_id": model_id})
                t.upsert("MODEL_ANCHOR", anchors)
            t.upsert("MAPPING_VERSION", version_row)
            t.upsert("SAMPLE_MAPPING", mapping)

    def _version(self, subject: str, version: str, source: Timeline, target: Timeline, method: str, model: str, parameters: dict, parent: str | None = None) -> DataFrame:
        row = (subject, version, source.run_id, source.device_type, target.run_id, target.device_type, version, method, parent, model, json.dumps(parameters, sort_keys=True))
        names = "subject_id mapping_version_id source_run_id source_device_type target_run_id target_device_type mapping_name mapping_method parent_mapping_version_id source_sync_model_id parameters_json"
        return self.spark.createDataFrame([row], ", ".join(f"{n} string" for n in names.split())).withColumn("created_at", F.current_timestamp())

    def _model(self, subject: str, model: str, source: Timeline, target: Timeline, kind: str, policy: str, parameters: str) -> DataFrame:
        row = (subject, model, source.run_id, source.device_type, target.run_id, target.device_type, source.timeline_model_id, target.timeline_model_id, model, kind, policy, parameters)
        names = "subject_id sync_model_id source_run_id source_device_type target_run_id target_device_type source_timeline_model_id target_timeline_model_id model_name model_type extrapolation_policy parameters_json"
        return self.spark.createDataFrame([row], ", ".join(f"{n} string" for n in names.split()))

    def map_nearest(self, source: Timeline, target: Timeline, version: str, config: NearestConfig = NearestConfig(), overwrite: bool = False) -> DataFrame:
        """Maps one pair of timelines on their own times; returns its diagnostics."""
        if source.subject_id != target.subject_id:
            raise ValueError("source and target must belong to one subject")
        subject = source.subject_id
        self._guard(subject, version, overwrite)
        times = self._times()
        src, tgt = select(times, source), select(times, target)
        kinds = _basis(src), _basis(tgt)
        if kinds[0] != kinds[1]:
            raise ValueError(f"timeline coordinates do not match: {kinds[0]} and {kinds[1]}")
        if kinds[0] == "numeric" and not config.allow_numeric_identity:
            raise ValueError("a mapping of numeric timelines has to be allowed by allow_numeric_identity")
        labelled = nearest_mapping(src, tgt, ["subject_id"], config)
        model = f"identity__{version}"
        row = self._model(subject, model, source, target, "identity_time", config.extrapolation_policy, json.dumps(asdict(config), sort_keys=True))
        made = self._version(subject, version, source, target, "initial_nearest_for_anchoring", model, asdict(config))
        self._save(subject, version, model, row, made, sample_mapping(labelled, subject, version, source, target))
        return mapping_diagnostics(labelled, ["subject_id"])

    def map_all(self, source_device: str, source_timeline: str, target_device: str, target_timeline: str, config: NearestConfig = NearestConfig(), min_overlap_sec: float = 5.0, overwrite: bool = False) -> DataFrame:
        """Maps all run pairs of every subject whose coverages overlap, in one job; returns a status for each pair."""
        times = self._times()
        side = lambda d, t: times.where((F.col("device_type") == d) & (F.col("timeline_model_id") == t))
        src, tgt = side(source_device, source_timeline), side(target_device, target_timeline)
        run = ["subject_id", "run_id"]
        cover = lambda df: df.select(*run, "time_basis").distinct().join(coverage(df, run), run, "left")
        cs, ct = cover(src), cover(tgt)
        pairs = overlap_pairs(cs, ct, ["subject_id"], "run_id", min_overlap_sec)
        basis = lambda df, p: df.select("subject_id", F.col("run_id").alias(f"{p}_run_id"), F.col("time_basis").alias(f"{p}_basis"))
        pairs = pairs.join(basis(cs, "source"), ["subject_id", "source_run_id"]).join(basis(ct, "target"), ["subject_id", "target_run_id"])
        mapped = pairs["status"].isin("mapped", "skipped_no_overlap", "skipped_below_min_overlap")
        status = F.when(mapped & (F.col("source_basis") != F.col("target_basis")), "skipped_coordinate_mismatch")
        if not config.allow_numeric_identity:
            status = status.when(mapped & (F.col("source_basis") == "numeric"), "skipped_numeric_identity_disabled")
        version = version_id((F.col("subject_id"), 40), (F.lit(f"{source_device}_to_{target_device}"), 30), (F.col("source_run_id"), 45), (F.col("target_run_id"), 45))
        pairs = pairs.withColumn("status", status.otherwise(F.col("status"))).withColumn("mapping_version_id", version)
        known = self.store.read("MAPPING_VERSION").select("subject_id", "mapping_version_id")
        if not overwrite and not pairs.where("status = 'mapped'").join(known, ["subject_id", "mapping_version_id"], "left_semi").limit(1).isEmpty():
            raise ValueError("a mapping version of a pair already exists")
        chosen = pairs.where("status = 'mapped'").select("subject_id", "source_run_id", "target_run_id", "mapping_version_id")
        key = ["subject_id", "mapping_version_id", "source_run_id", "target_run_id"]
        s = src.withColumnRenamed("run_id", "source_run_id").join(chosen, ["subject_id", "source_run_id"])
        t = tgt.withColumnRenamed("run_id", "target_run_id").join(chosen, ["subject_id", "target_run_id"])
        labelled = nearest_mapping(s, t, key, config).withColumns({"source_device_type": F.lit(source_device), "target_device_type": F.lit(target_device), "predicted_minus_estimated_ms": F.col("delta_ms")})
        versions = chosen.withColumns({
            "source_device_type": F.lit(source_device), "target_device_type": F.lit(target_device), "mapping_name": F.col("mapping_version_id"), "mapping_method": F.lit("initial_nearest_for_anchoring"),
            "created_at": F.current_timestamp(), "source_sync_model_id": F.concat(F.lit("identity__"), F.col("mapping_version_id")), "parameters_json": F.lit(json.dumps(asdict(config), sort_keys=True)),
        })
        models = versions.withColumns({"sync_model_id": F.col("source_sync_model_id"), "model_name": F.col("source_sync_model_id"), "model_type": F.lit("identity_time"), "source_timeline_model_id": F.lit(source_timeline), "target_timeline_model_id": F.lit(target_timeline), "extrapolation_policy": F.lit(config.extrapolation_policy)})
        # rows of the versions that are mapped anew go first
        from chronoweave.schemas import align

        held = self.store.read("SAMPLE_MAPPING").join(chosen.select("subject_id", "mapping_version_id"), ["subject_id", "mapping_version_id"], "left_anti")
        with self.store.transaction() as t:
            t.write("SAMPLE_MAPPING", align("SAMPLE_MAPPING", held).unionByName(align("SAMPLE_MAPPING", labelled)))
            t.upsert("SYNC_MODEL", models)
            t.upsert("MAPPING_VERSION", versions)
        rows = self.store.read("SAMPLE_MAPPING").groupBy("subject_id", "mapping_version_id").agg(F.count("*").alias("rows"))
        return pairs.join(rows, ["subject_id", "mapping_version_id"], "left").select("subject_id", "source_run_id", "target_run_id", "overlap_sec", "status", "mapping_version_id", F.when(F.col("status") == "mapped", F.coalesce("rows", F.lit(0))).alias("rows"))

    def anchor_pairs(self, source: Timeline, target: Timeline) -> DataFrame:
        """Anchors of a pair of runs with their times (seconds) in both timelines."""
        times = self._times()
        members = self.store.read("ANCHOR_MEMBER").where(F.col("subject_id") == source.subject_id)

        def side(timeline: Timeline, name: str) -> DataFrame:
            own = members.where((F.col("run_id") == timeline.run_id) & (F.col("device_type") == timeline.device_type))
            t = select(times, timeline).where("t is not null").select("sample_index", (F.col("t") / 1e6).alias(f"{name}_time"))
            return own.join(t, "sample_index").select("subject_id", "anchor_id", F.col("sample_index").alias(f"{name}_sample_index"), f"{name}_time")

        return side(source, "source").join(side(target, "target"), ["subject_id", "anchor_id"])

    def fit_piecewise(self, source: Timeline, target: Timeline, model: str, version: str, config: NearestConfig = NearestConfig(source_window_policy="all", allow_numeric_identity=True), policy: str = "disallow", parent: str | None = None, overwrite: bool = False, allow_mixed: bool = False) -> DataFrame:
        """Fits a clock model to a pair's anchors and maps through it; returns the diagnostics."""
        subject = source.subject_id
        if not overwrite and self.store.row_exists("SYNC_MODEL", {"subject_id": subject, "sync_model_id": model}):
            raise ValueError(f"sync model {model!r} already exists")
        self._guard(subject, version, overwrite)
        times = self._times()
        src, tgt = select(times, source), select(times, target)
        if not allow_mixed and _basis(src) != _basis(tgt):
            raise ValueError("timeline coordinates do not match; allow_mixed permits it")
        keys = ["subject_id"]
        anchors = self.anchor_pairs(source, target)
        if anchors.limit(2).count() < 2:
            raise ValueError("at least two usable anchors are required")
        pw.check_anchors(anchors, keys)
        segments = pw.fit_segments(anchors, keys)
        labelled = pw.piecewise_mapping(src, tgt, segments, keys, config, policy)
        loo = pw.leave_one_out(anchors, keys)
        # a model's anchors are set by hand: its document is small
        document = {n: [r.asDict() for r in df.drop("subject_id").collect()] for n, df in (("anchors", anchors), ("segments", segments), ("residuals", pw.anchor_residuals(anchors, segments, keys)), ("leave_one_out", loo))}
        document |= {"model_type": "piecewise_affine", "extrapolation_policy": policy}
        row = self._model(subject, model, source, target, "piecewise_affine", policy, json.dumps(document, sort_keys=True))
        made = self._version(subject, version, source, target, "nearest_predicted_time", model, asdict(config), parent)
        used = anchors.select("subject_id", F.lit(model).alias("sync_model_id"), "anchor_id")
        self._save(subject, version, model, row, made, sample_mapping(labelled, subject, version, source, target, "region"), used)
        extra = self.spark.createDataFrame([(subject, "anchors", float(len(document["anchors"]))), (subject, "segments", float(len(document["segments"])))], "subject_id string, metric string, value double")
        errors = loo.where("error_ms is not null").groupBy(keys).agg(F.percentile(F.abs("error_ms"), F.lit(0.5)).alias("loo_abs_error_ms_median"), F.max(F.abs("error_ms")).alias("loo_abs_error_ms_max"))
        return mapping_diagnostics(labelled, keys).unionByName(extra).unionByName(errors.unpivot(keys, ["loo_abs_error_ms_median", "loo_abs_error_ms_max"], "metric", "value"))
