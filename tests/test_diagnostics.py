"""Domain diagnostics, window loaders and lookups against numpy and by their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators import diagnostics as dg
from chronoweave.plans import context, windows

Q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@pytest.fixture(scope="module")
def domains():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(17, 3))
    out = []
    for turn in (np.eye(3), np.array(g.euler_rotation(0.3, -0.2, 0.5)).T):
        poses = (base + 0.05 * rng.normal(size=(9, 17, 3)) + rng.normal(size=(9, 1, 3))) @ turn
        points = rng.normal(size=(9, 6, 5)) + np.pad(poses[:, :1], ((0, 0), (0, 0), (0, 2)))
        out.append((points, poses))
    return out


def frames(spark, domain):
    rows = [(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(*domain, strict=True))]
    return spark.createDataFrame(rows, "frame_id long, points array<array<double>>, pose array<array<double>>")


def shape(poses):
    rel = poses - poses[:, :1]
    return rel / np.linalg.norm(poses[:, 8] - poses[:, 0], axis=1)[:, None, None]


def spread(poses):
    s = shape(poses)[:, list(g.BODY15)]
    return np.median(s, axis=0), np.maximum(np.quantile(s, 0.75, axis=0) - np.quantile(s, 0.25, axis=0), 1e-6)


def gap(ref, got):
    ref, got = ref.reshape(-1, 3), got.reshape(-1, 3)
    scale = np.maximum(np.quantile(ref, 0.75, axis=0) - np.quantile(ref, 0.25, axis=0), 0.05)
    return np.mean(np.abs(np.quantile(got, Q, axis=0) - np.quantile(ref, Q, axis=0)) / scale)


def test_reference_frames(spark, domains):
    (rp, rq), (tp, tq) = domains
    a, b = spread(tq)[0], spread(rq)[0]
    a, b = a - a.mean(0), b - b.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    got, before, after = dg.kabsch_rotation(frames(spark, domains[1]), frames(spark, domains[0]), "pose")
    np.testing.assert_allclose(got, turn, atol=1e-9)
    assert after < before and np.isclose(np.linalg.det(got), 1)
    level = np.array(g.sensor_rotation()).T
    shift = np.median(rq[:, 0], axis=0) - np.median(tq[:, 0] @ turn, axis=0)
    want = {}
    for name, r, t in (("sensor_as_recorded", np.eye(3), 0), ("mounting_rotation_only", level, 0), ("mounting_rotation_and_height", level, np.array([0, 0, g.SENSOR_HEIGHT_M])), ("pose_template_rotation_only", turn, 0), ("pose_template_rotation_and_translation", turn, shift)):
        poses, points = tq @ r + t, tp[:, :, :3] @ r + t
        m, iqr = spread(poses)
        rm, ri = spread(rq)
        pose_gap = np.mean(np.abs(m - rm) / np.maximum(ri, 0.05))
        log = np.mean(np.abs(np.log((iqr + 1e-4) / (ri + 1e-4))))
        ref, mine = (rp[:, :, :3] - rq[:, :1]).reshape(-1, 3), (points - poses[:, :1]).reshape(-1, 3)
        rc = np.cov(ref.T)
        cov = np.linalg.norm(np.cov(mine.T) - rc) / max(np.linalg.norm(rc), 1e-6)
        want[name] = (pose_gap, log, pose_gap + 0.35 * log, cov, gap(ref, mine) + 0.25 * cov, gap(rq, poses), gap(rp[:, :, :3], points))
    rows = dg.reference_frame_hypotheses(frames(spark, domains[0]), frames(spark, domains[1]), "frame_id", "points", "pose").collect()
    for r in rows:
        np.testing.assert_allclose([r.pose_median_gap, r.pose_iqr_gap, r.pose_score, r.point_covariance_gap, r.point_score, r.pose_xyz_gap, r.point_xyz_gap], want[r.hypothesis], rtol=1e-6)
    first = min(rows, key=lambda r: r["rank"])
    assert np.isclose(first.composite_score, min(w[2] + w[4] for w in want.values())) and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


def test_windowed_features(spark):
    rng = np.random.default_rng(1)
    p = np.hstack([rng.normal(size=(7, 5)), np.array([[-1.0], [-1], [0], [0], [0], [1], [1]])])
    p[2, 4] = p[3, 4]
    rows = [(p.tolist() + [[0.0] * 6], [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "p array<array<double>>, anchor array<double>")
    out = df.select(*[dg.windowed_features(F.col("p"), s, m, F.col("anchor")).alias(f"{s}_{m}") for s in ("legacy", "cloud_anchor") for m in ("none", "robust", "rank")]).first()
    q1, q2, q3 = np.quantile(p[:, 4], [0.25, 0.5, 0.75])
    robust = np.clip((p[:, 4] - q2) / max(q3 - q1, 1e-3), -5, 5) / 5
    below = np.array([(p[:, 4] < x).sum() + ((p[:, 4] == x).sum() + 1) / 2 for x in p[:, 4]])
    strength = {"none": [], "robust": [robust], "rank": [2 * below / 7 - 1]}
    for s in ("legacy", "cloud_anchor"):
        centre = np.median(p[:, :3], axis=0) if s == "legacy" else np.array([0.1, 0.2, 0.3])
        centred = np.clip((p[:, :3] - centre) / 2, -2, 2)
        first = [np.clip(p[:, :3] / 4, -2, 2), centred] if s == "legacy" else [centred, np.clip(np.linalg.norm(p[:, :3], axis=1) / 4, 0, 2)[:, None]]
        for m, extra in strength.items():
            want = np.column_stack([*first, np.clip(p[:, 3], -3, 3) / 3, *extra, p[:, 5]])
            got = np.array(out[f"{s}_{m}"])
            np.testing.assert_allclose(got[:7], want, atol=1e-9)
            assert not got[7].any()
    with pytest.raises(ValueError):
        dg.windowed_features(F.col("p"), "cloud_anchor")


def test_frame_balanced_sample(spark):
    point = lambda x: [float(x), 1.0, 1.0, 0.0, 0.0]
    frame = [(-1.0, [point(x) for x in (3, 1, 2)]), (0.0, [point(x) for x in range(9)]), (1.0, [[0.0] * 5])]
    empty = [(-1.0, None), (0.0, []), (1.0, [[0.0] * 5])]
    df = spark.createDataFrame([(1, frame), (2, empty)], "w long, frames array<struct<relative_time: double, points: array<array<double>>>>")
    got = {r.w: r for r in dg.frame_balanced_sample(df, ["w"], "frames", 10, 3).collect()}
    t = got[1].tokens
    assert [x[5] for x, m in zip(t, got[1].token_mask, strict=True) if m] == [-1.0] * 3 + [0.0] * 4 and len(t) == 10
    assert [x[0] for x in t[:3]] == [1.0, 2.0, 3.0] and {0.0, 8.0} <= {x[0] for x in t[3:7]}
    assert got[2].token_mask == [True] + [False] * 9 and not np.array(got[2].tokens).any()


def test_cloud_anchor(spark):
    line = [(t, [[1 + 0.5 * t + dx, 2.0 - t, 3.0, 0.0, 1.0] for dx in (-0.1, 0.0, 0.1)]) for t in (-1.0, -0.5, 0.0, 0.5, 1.0)]
    df = spark.createDataFrame([(1, t, p) for t, p in line] + [(1, 0.25, [[0.0] * 5]), (2, 0.0, [[4.0, 5.0, 6.0, 0.0, 1.0]])], "w long, relative_time double, points array<array<double>>")
    got = {r.w: r.anchor for r in dg.cloud_anchor(df, ["w"]).collect()}
    np.testing.assert_allclose(got[1], [1, 2, 3], atol=1e-4)
    np.testing.assert_allclose(got[2], [4, 5, 6], atol=1e-6)


@pytest.mark.parametrize("keys", [[], ["d"]])
def test_root_centred_sample(spark, keys):
    """Shares of frames, then the maximum over all frames of a domain; every point is one of its frame."""
    rng = np.random.default_rng(6)
    clouds = {(d, k): rng.normal(size=(6, 5)) for d, n in (("a", 30), ("b", 3)) for k in range(n)}
    df = spark.createDataFrame([(d, 100 * (d == "b") + k, c.tolist(), [[float(k), 0.0, 0.0]] * 17) for (d, k), c in clouds.items()], "d string, frame long, points array<array<double>>, pose array<array<double>>")
    for maximum in (8, 60, 1000):
        got = dg.root_centred_points(df, keys, "frame", "points", "pose", maximum).collect()
        groups = [[key for key in clouds if not keys or key[0] == d] for d in ("ab" if keys else "a")]
        assert len(got) == sum(min(maximum, len(own) * min(6, max(1, -(-maximum // len(own))))) for own in groups)
        for r in got:
            d, k = ("b", r.frame - 100) if r.frame >= 100 else ("a", r.frame)
            assert (np.abs(clouds[d, k][:, :3] - [k, 0, 0] - r.point).max(axis=1) < 1e-9).any()
        assert len({tuple(r.point) for r in got}) == len(got)


def test_window_anchors_once_per_frame(spark, monkeypatch):
    """Overlapping windows: as many medians as frames, and the values of a plain computation."""
    from chronoweave.operators import pose as ps

    rng = np.random.default_rng(4)
    clouds = {k: rng.normal(size=(5, 5)) + k for k in range(30)}
    clouds[11][:] = 0  # no valid point
    radar = spark.createDataFrame([("s", "t", "radar", k, c.tolist()) for k, c in clouds.items()], "subject_id string, run_id string, device_type string, sample_index long, points array<array<double>>")
    rows = [("s", "v", "c", "cam", k, "t", "radar", k) for k in range(2, 28)] + [("s", "v", "c", "cam", 100, "t", "radar", 5)]
    mapping = spark.createDataFrame(rows, "subject_id string, mapping_version_id string, source_run_id string, source_device_type string, source_sample_index long, target_run_id string, target_device_type string, target_sample_index long")
    usable = windows.radar_windows(mapping, radar, 5, None).withColumn("status", F.lit("ok"))
    calls, plain = spark.sparkContext.accumulator(0), ps.geometric_median

    def counted(cloud):
        @F.udf("array<double>")
        def seen(c):
            calls.add(1)
            return c

        return plain(F.when(seen(F.flatten(cloud)).isNotNull(), F.col(cloud)))

    monkeypatch.setattr(ps, "geometric_median", counted)
    found = windows.window_anchors(usable, radar).collect()
    assert calls.value == 29 and len(found) == len(rows)
    centre = {k: ps.weiszfeld(c[:, :3]) for k, c in clouds.items() if k != 11}
    for r in found:
        own = [(i / 2, centre[r.target_sample_index + i]) for i in range(-2, 3) if r.target_sample_index + i in centre]
        for axis in range(3):
            slope = np.median([(b[axis] - a[axis]) / (u - t) for t, a in own for u, b in own if u > t])
            assert r.anchor[axis] == pytest.approx(np.median([p[axis] - slope * t for t, p in own]), abs=1e-9)


def test_versions_and_bundles(spark):
    versions = spark.createDataFrame([("s1", "v2", "near"), ("s1", "v1", "near"), ("s2", "v3", "affine")], "subject_id string, mapping_version_id string, mapping_method string")
    assert [r.mapping_version_id for r in windows.select_mapping_versions(versions, ["s1", "s1"], ["near"]).collect()] == ["v1", "v2"]
    with pytest.raises(ValueError, match="affine"):
        windows.select_mapping_versions(versions, ["s2"], ["near"])
    assert context.mapping_context(versions, "s1", "v1")["mapping_method"] == "near" and context.unique_subject(versions, "v3") == "s2"
    with pytest.raises(KeyError):
        context.mapping_context(versions, "s1", "v9")
    assets = spark.createDataFrame([("a1", "s", "r", "d", "radar_points_bundle", "k", "x.npz"), ("a2", "s", "r", "d", "radar_points_bundle", "k", "x.npz"), ("a3", "s", "r", "e", "pose3d_bundle", "k", "y.npz"), ("a4", "s", "r", "e", "pose3d_bundle", "k", "z.npz")], "asset_id string, subject_id string, run_id string, device_type string, asset_role string, storage_key string, asset_ref string")
    need = lambda *rows: spark.createDataFrame(list(rows), "subject_id string, run_id string, device_type string, payload_role string")
    assert windows.resolve_bundles(assets, need(("s", "r", "d", "radar_points"))).first().asset_ref == "x.npz"
    for bad in (("s", "r", "e", "pose3d"), ("s", "r", "q", "pose3d"), ("s", "r", "d", "other")):
        with pytest.raises(ValueError):
            windows.resolve_bundles(assets, need(bad))
    assert context.asset_ref(assets, "s", "r", "d", "radar_points_bundle") == "x.npz"
    with pytest.raises(KeyError):
        context.asset_ref(assets, "s", "r", "d", "none")


def test_assets_are_found_under_their_roots(spark, tmp_path):
    for d in ("own", "other"):
        (tmp_path / d).mkdir()
    (tmp_path / "other" / "x.npz").write_bytes(b"1")
    (tmp_path / "own" / "y.npz").write_bytes(b"1")
    assets = spark.createDataFrame([("a", "s", "r", "d", "p", "k", "./x.npz"), ("b", "s", "r", "d", "q", "k", "y.npz"), ("c", "s", "r", "d", "z", None, "w.npz")], "asset_id string, subject_id string, run_id string, device_type string, asset_role string, storage_key string, asset_ref string")
    roots = {"k": [f"{tmp_path}/own"], "default": [f"{tmp_path}/other", f"{tmp_path}/own"]}
    got = {r.asset_id: r.path for r in context.first_existing(spark, assets, roots).collect()}
    assert got == {"a": f"{tmp_path}/other/x.npz", "b": f"{tmp_path}/own/y.npz", "c": None}
    assert context.resolve_run_asset(spark, assets, {"k": f"{tmp_path}/own"}, "s", "r", "d", "q") == f"{tmp_path}/own/y.npz"
    with pytest.raises(FileNotFoundError):
        context.resolve_run_asset(spark, assets, {"k": f"{tmp_path}/own"}, "s", "r", "d", "p")
    with pytest.raises(KeyError):
        context.resolve_run_asset(spark, assets, {}, "s", "r", "d", "p")


def test_projection_stays_small(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0, 0.1, 5.0, 7.0]],)], "c array<array<double>>").select(g.project_cloud(F.col("c")).alias("uv"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    assert len(df.first().uv[0]) == 6


def test_small_functions(spark):
    df = spark.createDataFrame([("../a b//c..", float("nan"))], "n string, x double")
    r = df.select(context.safe_path_component(F.col("n")).alias("n"), context.json_ready(F.struct("n", "x")).alias("j"), g.point_colour(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), "snr").alias("c")).first()
    assert r.n == "a_b_c" and r.j == '{"n":"../a b//c..","x":null}' and r.c == list(g.CONSTANT_COLOUR)
