"""Ingest, mapping services, clock models and lookups on small packages with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def package(spark):
    run = "P001", "Session-A"
    at = lambda us: f"2024-01-01T12:00:00.{us:06d}"
    runs = spark.createDataFrame([(*run, d, at(0), "2024-01-01T12:00:01.000000", fps, "") for d, fps in (("kinect_rgb", 15), ("radar_pc", 20))], "subject_id string, run_id string, device_type string, start_wallclock_est string, end_wallclock_est string, nominal_fps int, notes string")
    wall, elapsed, os_time = (0, 66667, 133333, 200000), (0.0, float("nan"), 2 / 15, float("nan")), (at(10000), "", at(143333), "")
    rgb = spark.createDataFrame([(*run, i, i / 15, at(wall[i]), elapsed[i], os_time[i], "frame", "P001\\Session-A\\video.mp4") for i in range(4)], "subject_id string, run_id string, frame_number long, pts_sec double, wallclock_est string, kinect_internal_elapsed_sec double, smartcup_os_time string, sample_kind string, video_ref string")
    seen = (0, 52000, 99000, 151000, 202000, 251000)
    radar = spark.createDataFrame([(*run, i, at(seen[i]), [[float(i)] * 6] * (i % 3)) for i in range(6)], "subject_id string, run_id string, frame_number long, observed_wallclock string, points array<array<double>>")
    return {"device_runs": runs, "rgb_samples": rgb, "radar_pc_samples": radar}


@pytest.fixture()
def store(spark, package, tmp_path):
    from chronoweave.plans.ingest import ingest
    from chronoweave.sources.store import ParquetStore

    s = ParquetStore(spark, f"file://{tmp_path}/store")
    s.reports = ingest(s, package)
    return s


def test_ingest_and_mapping(spark, store):
    from chronoweave.operators.nearest import NearestConfig
    from chronoweave.plans.mapping import MappingService, Timeline

    assert store.read("SUBJECT").count() == 1 and store.read("RUN_SAMPLE").count() == 10 and len(store.list_tables()) == 14
    ids = {r[0] for r in store.read("RUN_TIMELINE_MODEL").select("timeline_model_id").collect()}
    assert len(ids) == 8 and "rgb_smartcup_os_from_pts" in ids
    radar = store.read("SAMPLE_TIME_ESTIMATE").where("timeline_model_id = 'radar_pc_linear_from_index'").orderBy("sample_index").select(F.unix_micros("time_value_datetime") % 1_000_000, "residual_ms").collect()
    assert [r[0] for r in radar] == [333, 50533, 100733, 150933, 201133, 251333]
    assert np.allclose([r[1] for r in radar], [-0.3333, 1.4667, -1.7333, 0.0667, 0.8667, -0.3333], atol=1e-3)
    fit = {r.metric: r.value for r in store.reports["timeline_fit"].where("timeline_model_id = 'radar_pc_linear_from_index'").collect()}
    assert abs(fit["slope_sec"] - 0.0502) < 1e-9 and abs(fit["rmse_ms"] - 1.01105) < 1e-4
    assert store.read("RUN_ASSET").first().asset_ref == "P001/Session-A/video.mp4"

    service = MappingService(store)
    src, tgt = Timeline("P001", "Session-A", "kinect_rgb", "rgb_wallclock_from_pts"), Timeline("P001", "Session-A", "radar_pc", "radar_pc_linear_from_index")
    got = {(r.metric): r.value for r in service.map_nearest(src, tgt, "v1").collect()}
    assert (got["sample_mapping_rows"], got["mapped_sources"], got["primary_rows"]) == (9, 3, 3)
    rows = {(r.source_sample_index, r["rank"]): r for r in store.read("SAMPLE_MAPPING").collect()}
    golden = {(1, 1): (1, -16.134), (1, 2): (2, 34.066), (1, 3): (0, -66.334), (2, 1): (3, 17.6), (2, 2): (2, -32.6), (2, 3): (4, 67.8), (3, 1): (4, 1.133), (3, 2): (3, -49.067), (3, 3): (5, 51.333)}
    for key, (target, delta) in golden.items():
        r = rows[key]
        assert r.target_sample_index == target and abs(r.predicted_minus_estimated_ms - delta) < 2e-3
        assert r.support_status == "supported" and r.is_primary == (key[1] == 1) and abs(r.confidence_score - (1 - abs(delta) / 200)) < 1e-5
    with pytest.raises(ValueError, match="already exists"):
        service.map_nearest(src, tgt, "v1")
    service.map_nearest(src, tgt, "v1", NearestConfig(top_k=1), overwrite=True)
    assert [r["rank"] for r in store.read("SAMPLE_MAPPING").collect()] == [1, 1, 1]
    status = service.map_all("kinect_rgb", "rgb_wallclock_from_pts", "radar_pc", "radar_pc_linear_from_index", NearestConfig(top_k=1), 0.0).collect()
    assert [(r.status, r.rows) for r in status] == [("mapped", 3)]
    assert service.map_all("kinect_rgb", "rgb_wallclock_from_pts", "radar_pc", "radar_pc_linear_from_index", min_overlap_sec=99.0).first().status == "skipped_below_min_overlap"
    with pytest.raises(ValueError, match="do not match"):
        service.map_nearest(Timeline("P001", "Session-A", "kinect_rgb", "rgb_pts_elapsed"), tgt, "v2")


def test_anchors_and_piecewise(spark, tmp_path):
    from chronoweave.cli import main
    from chronoweave.operators.lookup import best_rows
    from chronoweave.operators.nearest import NearestConfig
    from chronoweave.plans.anchors import AnchorService
    from chronoweave.plans.mapping import MappingService, Timeline
    from chronoweave.sources.store import ParquetStore

    store = ParquetStore(spark, f"file://{tmp_path}/toy")
    rows = [("P001", "RGB-A", "kinect_rgb", "rgb_t", i, float(i), "x") for i in range(5)] + [("P001", "PC-A", "radar_pc", "pc_t", i, float(i + 1), "x") for i in range(6)]
    store.write("SAMPLE_TIME_ESTIMATE", spark.createDataFrame(rows, "subject_id string, run_id string, device_type string, timeline_model_id string, sample_index long, time_value_sec double, time_kind string"))
    anchors = AnchorService(store)
    for name, i in (("a_start", 0), ("a_end", 4)):
        anchors.create_pair("P001", ("RGB-A", "kinect_rgb", i), ("PC-A", "radar_pc", i), name)
    with pytest.raises(ValueError, match="already exists"):
        anchors.create_pair("P001", ("RGB-A", "kinect_rgb", 0), ("PC-A", "radar_pc", 0), "a_end")
    pair = ("RGB-A", "kinect_rgb"), ("PC-A", "radar_pc")
    assert anchors.pairs("P001", *pair).count() == 2
    src, tgt = Timeline("P001", "RGB-A", "kinect_rgb", "rgb_t"), Timeline("P001", "PC-A", "radar_pc", "pc_t")
    MappingService(store).fit_piecewise(src, tgt, "m1", "v1", NearestConfig(top_k=1))
    got = {r.source_sample_index: (r.target_sample_index, r.predicted_minus_estimated_ms) for r in store.read("SAMPLE_MAPPING").collect()}
    assert got == {i: (i, 0.0) for i in range(5)} and store.read("MODEL_ANCHOR").count() == 2
    mapping = store.read("SAMPLE_MAPPING").withColumnRenamed("predicted_minus_estimated_ms", "delta_ms")
    assert best_rows(mapping, ["source_sample_index"]).where("source_sample_index = 2").first().target_sample_index == 2
    document = json.loads(store.read("SYNC_MODEL").first().parameters_json)
    assert document["segments"][0]["slope"] == 1 and {x["status"] for x in document["leave_one_out"]} == {"insufficient_training_anchors"}
    file = f"{tmp_path}/anchors.json"
    assert anchors.export_json(file, "P001", *pair) == 2
    anchors.delete("P001", "a_end")
    with pytest.raises(KeyError):
        anchors.delete("P001", "a_end")
    assert main(["import-anchors", "--store", store.root, "--file", file, "--overwrite"], spark) == 0
    assert anchors.pairs("P001", *pair).count() == 2


def test_piecewise_model(spark):
    from chronoweave.operators import piecewise as pw

    anchors = spark.createDataFrame([("g", f"a{i}", 10.0 * i, 10.0 * i + 1) for i in range(3)], "g string, anchor_id string, source_time double, target_time double")
    segments = pw.fit_segments(anchors, ["g"])
    times = spark.createDataFrame([("g", t) for t in (5.0, -1.0, 21.0, 20.0, float("nan"))] + [("h", 1.0)], "g string, source_time double")
    out = {str(r.source_time) + r.g: (r.target_time, r.region) for r in pw.predict(times, segments, ["g"], "allow_linear").collect()}
    assert out == {"5.0g": (6.0, "interpolation"), "-1.0g": (0.0, "left_extrapolation"), "21.0g": (22.0, "right_extrapolation"), "20.0g": (21.0, "interpolation"), "nang": (None, "unsupported"), "1.0h": (None, "unsupported")}
    assert {r.residual_ms for r in pw.anchor_residuals(anchors, segments, ["g"]).collect()} == {0.0}
    with pytest.raises(ValueError, match="strictly increasing"):
        pw.check_anchors(anchors.unionByName(anchors.limit(1).withColumn("anchor_id", F.lit("b"))), ["g"])


def test_synthetic_cases(spark):
    from chronoweave.plans.synthetic import report

    got = {r["case"]: r for r in report(spark).collect()}
    assert len(got) == 10 and got["identity"].max_error_ms < 1e-6 and got["identity"].samples == 301
    assert got["piecewise_drift"].max_error_ms < 1e-6 and got["bad_anchor"].max_error_ms > 1000


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_brute_force(spark, k):
    from chronoweave.operators.nearest import nearest_targets

    rng = np.random.default_rng(k)
    rows = {s: [(g, i, int(t)) for g in "ab" for i, t in enumerate(rng.integers(0, 400, 60))] for s in ("src", "tgt")}
    frame = lambda r: spark.createDataFrame(r, "g string, sample_index long, t long")
    got: dict = {}
    for r in nearest_targets(frame(rows["src"] + [("c", 0, 5)]), frame(rows["tgt"]), ["g"], k, slice_width=70).collect():
        got[r.g, r.source_sample_index, r["rank"]] = r.target_sample_index
    want = {}
    for g, i, t in rows["src"]:
        order = sorted((abs(u - t), u, j) for h, j, u in rows["tgt"] if h == g)
        want |= {(g, i, n + 1): order[n][2] for n in range(k)}
    assert got == want


def test_payloads(spark, package, store, tmp_path):
    from chronoweave.plans.audit import audit
    from chronoweave.plans.payloads import build_artifacts, mapped_pair, read_payloads
    from chronoweave.plans.mapping import MappingService, Timeline
    from chronoweave.sources.payloads import npz_bundles, ragged_index, ragged_issues

    path = f"file://{tmp_path}/payloads"
    build_artifacts(store, path, None, package["radar_pc_samples"])
    assert store.read("SAMPLE_ARTIFACT").count() == 6 and [r.has_points for r in store.read("SAMPLE_SUMMARY").orderBy("sample_index").collect()] == [False, True, True] * 2
    assert store.read("SAMPLE_ARTIFACT").where("sample_index = 2").first().payload_shape == "[2,6]"
    MappingService(store).map_nearest(Timeline("P001", "Session-A", "kinect_rgb", "rgb_wallclock_from_pts"), Timeline("P001", "Session-A", "radar_pc", "radar_pc_linear_from_index"), "v1")
    both = {r.side: r for r in mapped_pair(store.read("SAMPLE_MAPPING"), read_payloads(spark, path), store.read("SAMPLE_SUMMARY"), "v1", 2).collect()}
    assert both["target"].sample_index == 3 and both["source"].payload is None
    files = store.read("SAMPLE_ARTIFACT").select(F.col("artifact_ref").alias("ref")).unionByName(store.read("RUN_ASSET").select(F.col("asset_ref").alias("ref")))
    assert audit(store.read("RUN_ASSET"), store.read("SAMPLE_ARTIFACT"), store.read("SAMPLE_SUMMARY"), files=files).count() == 0
    assert audit(store.read("RUN_ASSET"), store.read("SAMPLE_ARTIFACT"), store.read("SAMPLE_SUMMARY"), files=files.limit(0)).where("severity = 'error'").count() == 6
    ragged = spark.createDataFrame([("r", 2, [[1.0] * 6] * 2), ("r", 0, []), ("r", 1, [[3.0] * 6])], "run string, sample_index long, values array<array<double>>")
    index = ragged_index(ragged, ["run"])
    assert [(r.sample_index, r.begin, r.end) for r in index.orderBy("sample_index").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 3)]
    assert ragged_issues(index, ["run"]).count() == 0 and ragged_issues(index.where("sample_index > 1"), ["run"]).count() == 1
    assert len(npz_bundles(ragged, ["run"]).collect()) == 1


def test_store(spark, tmp_path):
    from chronoweave.sources.store import ParquetStore

    s = ParquetStore(spark, f"file://{tmp_path}/s")
    row = lambda *r: spark.createDataFrame([r], "subject_id string, notes string")
    assert s.read("SUBJECT").count() == 0
    s.upsert("SUBJECT", row("a", "1"))
    s.upsert("SUBJECT", row("b", None))
    s.upsert("SUBJECT", row("a", "2"))
    assert sorted((r.subject_id, r.notes) for r in s.read("SUBJECT").collect()) == [("a", "2"), ("b", None)]
    assert s.row_exists("SUBJECT", {"subject_id": "a"}) and s.delete_where("SUBJECT", {"notes": "2"}) == 1 and s.read("SUBJECT").count() == 1
    for bad, error in (({}, ValueError), ({"zzz": 1}, KeyError)):
        with pytest.raises(error):
            s.row_exists("SUBJECT", bad)
    with pytest.raises(KeyError):
        s.read("NOPE")


def test_geometry_and_poses(spark):
    from chronoweave.functions import geometry as g
    from chronoweave.operators import pose
    from chronoweave.operators.frames import frame_quotas

    rng = np.random.default_rng(1)
    cloud = [[float(x) for x in rng.normal(size=6)] for _ in range(12)]
    body = rng.normal(size=(17, 3))
    turn = np.array(g.euler_rotation(0.3, -0.2, 0.9))
    moved = (1.7 * body @ turn.T + [1, 2, 3]).tolist()
    df = spark.createDataFrame([(1, cloud, body.tolist(), moved)], "id int, points array<array<double>>, truth array<array<double>>, pred array<array<double>>")
    noisy = [[0.0] * 5 + [float(t)] for t in (0, 253, 254, 255, float("nan"), 7)]
    ids = spark.createDataFrame([(noisy,)], "p array<array<double>>").select(g.without_noise(F.col("p")).alias("p")).first().p
    assert [p[5] for p in ids] == [0, 7]
    out = df.select(g.pose_to_sensor(F.array(F.array(*map(F.lit, (1000.0, 2000.0, 3000.0))))).alias("s"), pose.geometric_median("points").alias("m"), pose.farthest_points(4)("points").alias("f"), g.project_cloud(F.col("points")).alias("uv")).first()
    assert np.allclose(out.s, [[1, 3, -2]]) and len(out.f) == 4 and all(len(p) == 6 for p in out.uv)
    xyz = np.array(cloud)[:, :3]
    cost = lambda p: np.linalg.norm(xyz - p, axis=1).sum()
    assert all(cost(np.array(out.m)) <= cost(np.array(out.m) + d) + 1e-6 for d in rng.normal(size=(20, 3)) * 0.05)
    metrics = pose.pose_metrics(df, ["id"]).first()
    assert metrics.pa_mpjpe_mm < 1e-6 < metrics.mpjpe_mm and metrics.frames == 1
    scale, rotation, shift = pose.global_similarity(df)
    assert abs(scale * 1.7 - 1) < 1e-9
    back = df.select(pose.apply_similarity(F.col("pred"), (scale, rotation, shift)).alias("b")).first().b
    assert np.allclose(back, body)
    for mode in ("absolute", "pelvis_relative", "cloud_anchor_relative"):
        anchor = F.array(*map(F.lit, (0.5, 0.25, 1.0)))
        again = df.select(g.decode_target(g.encode_target(F.col("truth"), mode, anchor), mode, anchor).alias("t")).first().t
        assert np.allclose(again, body)
    assert frame_quotas(27, 5) == [5, 6, 6, 5, 5] or sum(frame_quotas(27, 5)) == 27
    assert len(g.axis_transforms()) == 48 and sum(d for *_, d in g.axis_transforms()) == 0
    assert np.allclose(g.euler_angles(np.array(g.euler_rotation(0.3, -0.2, 0.9)).T.tolist()), np.degrees([0.3, -0.2, 0.9]))


def test_plan_of_the_nearest_join(spark, sf_dir):
    from __spark_entry__ import entry

    df = entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert df.count() > 0
