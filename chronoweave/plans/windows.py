"""Windows of radar frames for supervision, inference and diagnosis, with the reason for each one that is left out.

rows: primary mapping rows with subject_id, mapping_version_id, source_* and target_*
(run_id, device_type, sample_index). radar and poses: subject_id, run_id, device_type,
sample_index and points or pose3d. All of it is equi-joins on exploded indices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators.diagnostics import frame_anchors, lines_at_zero
from chronoweave.operators.frames import frame_stride, strided_windows, window_status, window_support
from chronoweave.operators.pose import pose_metrics

#: Seconds between the frames of a window by default.
PERIOD_SEC = 0.1
TARGET = ["subject_id", "target_run_id", "target_device_type"]
SOURCE = ["subject_id", "source_run_id", "source_device_type", "source_sample_index"]
ROW = ["subject_id", "mapping_version_id", *SOURCE[1:], *TARGET[1:], "target_sample_index"]
#: The bundle of each payload role.
BUNDLE_ROLES = {"radar_points": "radar_points_bundle", "pose3d": "pose3d_bundle"}


def select_mapping_versions(versions: DataFrame, subjects: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """The mapping versions of the given subjects and methods, in order; without any, an error names what there is."""
    if not subjects or not methods:
        raise ValueError("at least one subject and one mapping method are needed")
    of_subjects = versions.where(F.col("subject_id").isin(*dict.fromkeys(subjects)))
    chosen = of_subjects.where(F.col("mapping_method").isin(*dict.fromkeys(methods)))
    if chosen.isEmpty():
        # a row for each subject asked for and method
        have = [(r[0], r[1]) for r in of_subjects.select("subject_id", "mapping_method").distinct().orderBy("subject_id", "mapping_method").collect()]
        raise ValueError(f"no mapping version matches; for these subjects there are {have}")
    return chosen.orderBy("subject_id", "mapping_version_id")


def resolve_bundles(assets: DataFrame, needed: DataFrame) -> DataFrame:
    """needed (subject_id, run_id, device_type, payload_role) with asset_ref: the one bundle of each; none or several is an error."""
    roles = F.create_map(*[F.lit(x) for pair in BUNDLE_ROLES.items() for x in pair])
    wanted = needed.distinct().withColumn("asset_role", F.element_at(roles, F.col("payload_role")))
    key = ["subject_id", "run_id", "device_type", "asset_role"]
    refs = assets.where("asset_ref is not null").groupBy(key).agg(F.countDistinct("asset_ref").alias("_n"), F.min("asset_ref").alias("asset_ref"))
    found = wanted.join(refs, key, "left")
    bad = found.where("asset_role is null or _n is null or _n <> 1").limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(f"{r['subject_id']}/{r['run_id']}/{r['device_type']}: {r['_n'] or 0} bundles of {r['payload_role']}, one expected")
    return found.drop("_n")


def radar_windows(rows: DataFrame, radar: DataFrame, width: int, fps: DataFrame | None, period_sec: float = PERIOD_SEC, noise_filter: bool = False) -> DataFrame:
    """rows with `frames` (relative_time, points), n_frames, window bounds, stride and support counts.

    fps: subject_id, run_id, device_type, target_fps; without it the stride is one frame.
    """
    rows = rows.select(*ROW)
    if fps is None:
        rows = rows.withColumn("stride", F.lit(1))
    else:
        rate = fps.select("subject_id", F.col("run_id").alias("target_run_id"), F.col("device_type").alias("target_device_type"), "target_fps")
        rows = rows.join(rate, TARGET).withColumn("stride", frame_stride(period_sec))
    frames = radar.select("subject_id", F.col("run_id").alias("target_run_id"), F.col("device_type").alias("target_device_type"), "sample_index", g.radar_points(F.col("points"), noise_filter).alias("points"))
    out = window_support(strided_windows(rows, frames, TARGET, width, "points"), lambda p: F.size(g.model_points(p)))
    half = width // 2
    return out.withColumns({"target_window_start": F.col("target_sample_index") - half * F.col("stride"), "target_window_end": F.col("target_sample_index") + half * F.col("stride")})


def with_pose(windows: DataFrame, poses: DataFrame, person: int = 0, euler_deg: Sequence[float] = (0.0, 0.0, 0.0), translation: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """windows with the source sample's 17 joints: pose (null unless finite), pose_found, pose_valid."""
    truth = poses.select("subject_id", F.col("run_id").alias("source_run_id"), F.col("device_type").alias("source_device_type"), F.col("sample_index").alias("source_sample_index"), g.pose_17(F.col("pose3d"), person, euler_deg, translation).alias("_pose"), F.lit(True).alias("pose_found"))
    out = windows.join(truth, SOURCE, "left")
    finite = F.coalesce(F.forall("_pose", lambda j: F.forall(j, g.is_finite)), F.lit(False))
    return out.withColumn("pose_found", F.coalesce("pose_found", F.lit(False))).withColumn("pose_valid", finite).withColumn("pose", F.when(finite, F.col("_pose"))).drop("_pose")


def _limits(width: int, least_centre: int, least_window: int, least_frames: int) -> None:
    if least_centre < 1 or least_window < 1:
        raise ValueError("point limits must be positive")
    if not 1 <= least_frames <= width:
        raise ValueError("least_frames must lie between 1 and the width")


def supervised_windows(rows: DataFrame, radar: DataFrame, poses: DataFrame, width: int, fps: DataFrame, least_centre: int = 1, least_window: int = 1, least_frames: int = 1, noise_filter: bool = False, period_sec: float = PERIOD_SEC, **pose) -> DataFrame:
    """Every row with its window, pose and `status`: ok, or the first reason why it cannot serve for supervision."""
    _limits(width, least_centre, least_window, least_frames)
    windows = with_pose(radar_windows(rows, radar, width, fps, period_sec, noise_filter), poses, **pose)
    return window_status(windows, width, least_centre, least_window, least_frames, "pose")


def inference_windows(rows: DataFrame, radar: DataFrame, poses: DataFrame, width: int, fps: DataFrame, least_centre: int = 1, least_window: int = 1, least_frames: int = 1, noise_filter: bool = False, period_sec: float = PERIOD_SEC, **pose) -> DataFrame:
    """As supervised_windows, but a missing or invalid pose keeps the row: ground_truth_available is false there.

    All target runs must have one rate in common.
    """
    _limits(width, least_centre, least_window, least_frames)
    if fps.agg(F.countDistinct("target_fps")).first()[0] > 1:
        raise ValueError("target runs differ in their rate")
    windows = with_pose(radar_windows(rows, radar, width, fps, period_sec, noise_filter), poses, **pose)
    out = window_status(windows, width, least_centre, least_window, least_frames)
    missing = F.when(~F.col("pose_found"), "missing_pose_payload").when(~F.col("pose_valid"), "invalid_pose")
    return out.withColumn("ground_truth_available", F.col("pose_valid")).withColumn("ground_truth_issue", missing)


def diagnostic_windows(rows: DataFrame, radar: DataFrame, poses: DataFrame, width: int, noise_filter: bool = False, **pose) -> DataFrame:
    """Windows of consecutive frames that all hold points, with a finite pose; `status` says why a row has none."""
    windows = with_pose(radar_windows(rows, radar, width, None, noise_filter=noise_filter), poses, **pose)
    empty = F.exists("frames", lambda f: F.size(g.diagnostic_points(f["points"])) == 0)
    status = F.when(F.col("n_frames") < width, "incomplete_radar_window").when(empty, "empty_radar_frame")
    status = status.when(~F.col("pose_found"), "missing_pose_payload").when(~F.col("pose_valid"), "invalid_pose")
    return windows.withColumn("status", status.otherwise("ok"))


def window_counts(windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of each status, by mapping version unless other keys are given."""
    keys = ["subject_id", "mapping_version_id"] if keys is None else keys
    return windows.groupBy(*keys, "status").agg(F.count("*").alias("rows"))


def window_anchors(windows: DataFrame, radar: DataFrame, noise_filter: bool = False) -> DataFrame:
    """Usable windows with their robust cloud anchor.

    A frame that stands in many windows gets its geometric median once; windows meet
    their frames' anchors by run and index.
    """
    fine = windows.where("status = 'ok'")
    frame = [*TARGET, "index"]
    wanted = fine.select(*ROW, F.explode("frames").alias("_f")).select(*ROW, "_f.relative_time", "_f.index")
    frames = radar.select("subject_id", F.col("run_id").alias("target_run_id"), F.col("device_type").alias("target_device_type"), F.col("sample_index").alias("index"), g.radar_points(F.col("points"), noise_filter).alias("points"))
    known = frame_anchors(frames.join(wanted.select(frame).distinct(), frame, "left_semi"))
    return fine.join(lines_at_zero(wanted.join(known, frame), ROW), ROW)


def stacked_points(frames: str = "frames"):
    """A window's points as one array, each with its frame's relative time as the sixth number."""
    timed = F.transform(frames, lambda f: F.transform(f["points"], lambda p: F.concat(F.slice(p, 1, 5), F.array(f["relative_time"].cast("double")))))
    return F.flatten(timed)


def version_metrics(windows: DataFrame, pred: str = "pred", truth: str = "pose") -> DataFrame:
    """Pose metrics of every mapping version in one job, on all joints and on the body joints."""
    keys = ["subject_id", "mapping_version_id"]
    parts = [pose_metrics(windows, keys, pred, truth, joints, aligned=False).withColumn("joints", F.lit(name)) for name, joints in (("all17", tuple(range(17))), ("body15", g.BODY15))]
    return parts[0].unionByName(parts[1])
