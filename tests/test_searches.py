"""Axis searches, alignment and point selection against plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import pose as ps

BONES = ((0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8), (8, 9), (9, 10), (7, 11), (11, 12), (12, 13), (7, 14), (14, 15), (15, 16))
BODY = [j for j in range(17) if j not in (9, 10)]
POSE = "array<array<double>>"


def transforms():
    """name: a function of points, for the 48 signed permutations of the axes."""
    out = {}
    for perm in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            name = ",".join(("-" if s < 0 else "") + "xyz"[i] for i, s in zip(perm, signs, strict=True))
            out[name] = lambda p, perm=perm, signs=signs: p[..., list(perm)] * np.array(signs)
    return out


def bodies(seed, n, turn=lambda p: p):
    """n frames: a pose and points near its limbs, which stand as `turn` has the pose."""
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(17, 3)) * [0.3, 0.2, 0.6]
    poses = shape + rng.normal(size=(n, 1, 3)) * [1.0, 0.7, 0.4] + 0.05 * rng.normal(size=(n, 17, 3))
    at = rng.integers(0, 16, (n, 25))
    ends = turn(poses)
    a, b = (ends[np.arange(n)[:, None], np.array(BONES)[at][..., k]] for k in (0, 1))
    return poses, a + rng.random((n, 25, 1)) * (b - a) + 0.03 * rng.normal(size=(n, 25, 3))


def to_skeleton(points, pose):
    out = np.full(len(points), np.inf)
    for i, j in BONES:
        ab = pose[j] - pose[i]
        t = np.clip((points - pose[i]) @ ab / max(ab @ ab, 1e-12), 0, 1)
        out = np.minimum(out, np.linalg.norm(points - pose[i] - t[:, None] * ab, axis=1))
    return out


def scaled(x, reverse=False):
    part = (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.zeros(len(x))
    return 1 - part if reverse else part


def test_axis_search(spark):
    turn = transforms()["-y,x,z"]
    poses, clouds = bodies(1, 30, turn)
    centre = np.median(clouds, axis=1)
    want = {}
    for name, move in transforms().items():
        moved = move(poses)
        gap = centre - moved[:, 0]
        shift = np.median(gap, axis=0)
        rmse = np.sqrt(((shift - gap) ** 2).sum() / len(gap))
        near = np.median([np.quantile(to_skeleton(c, m + shift), 0.25) for c, m in zip(clouds, moved, strict=True)])
        corr = np.mean([np.corrcoef(moved[:, 0, k], centre[:, k])[0, 1] for k in range(3)])
        want[name] = rmse, near, corr, *shift
    names = sorted(want)
    columns = np.array([want[n] for n in names])
    score = 0.45 * scaled(columns[:, 0]) + 0.45 * scaled(columns[:, 1]) + 0.1 * scaled(columns[:, 2], True)
    df = spark.createDataFrame([(k, p.tolist(), c.tolist()) for k, (p, c) in enumerate(zip(poses, clouds, strict=True))], f"frame long, pose {POSE}, points {POSE}")
    got = {r.transform: r for r in ps.axis_search(df, "frame", "points", "pose").collect()}
    assert set(got) == set(names)
    for n, row, s in zip(names, columns, score, strict=True):
        r = got[n]
        assert (r.root_centroid_rmse, r.skeleton_q25, r.axis_correlation, *r.translation, r.composite_score) == pytest.approx([*row, s], abs=1e-9)
    assert [r.transform for r in sorted(got.values(), key=lambda r: r.rank)] == [n for _, n in sorted(zip(score.round(12).tolist(), names, strict=True))]
    assert got["-y,x,z"]["rank"] == 1


def test_searches_at_scale_give_the_same(spark, monkeypatch):
    """Medians by refinement instead of one aggregate."""
    from chronoweave.operators import scan, statistics

    poses, clouds = bodies(2, 6)
    df = spark.createDataFrame([(k, p.tolist(), c.tolist()) for k, (p, c) in enumerate(zip(poses, clouds, strict=True))], f"frame long, pose {POSE}, points {POSE}")
    small = {r.transform: r.composite_score for r in ps.axis_search(df, "frame", "points", "pose").collect()}
    monkeypatch.setattr(scan, "WHOLE", 0)
    monkeypatch.setattr(statistics, "BUCKETS", 4)
    large = {r.transform: r.composite_score for r in ps.axis_search(df, "frame", "points", "pose").collect()}
    assert large == pytest.approx(small)


def shapes(poses):
    """Root-relative joints over the pelvis-to-neck length, or the median bone where that is short."""
    out = []
    for p in poses:
        neck = np.linalg.norm(p[8] - p[0])
        bones = np.median([np.linalg.norm(p[i] - p[j]) for i, j in BONES])
        out.append((p - p[0]) / max(neck if neck > 0.2 else bones, 1e-3))
    return np.array(out)[:, BODY]


def test_pose_axis_search(spark):
    ref, _ = bodies(3, 40)
    cand = transforms()["x,-z,y"](bodies(4, 30)[0])
    spread = lambda p: (np.median(shapes(p), axis=0), np.maximum(np.subtract(*np.quantile(shapes(p), [0.75, 0.25], axis=0)), 1e-6))
    rm, ri = spread(ref)
    want = {}
    for name, move in transforms().items():
        m, i = spread(move(cand))
        want[name] = np.mean(np.abs(m - rm) / np.maximum(ri, 0.05)), np.mean(np.abs(np.log((i + 1e-4) / (ri + 1e-4))))
    frame = lambda p: spark.createDataFrame([(x.tolist(),) for x in p], f"pose {POSE}")
    rows = ps.pose_axis_search(frame(ref), frame(cand), "pose").collect()
    assert len(rows) == 48
    for r in rows:
        gap, log = want[r.transform]
        assert (r.median_gap, r.iqr_gap, r.score) == pytest.approx((gap, log, gap + 0.35 * log), abs=1e-9)
    assert sorted(r["rank"] for r in rows) == list(range(1, 49)) and [r.score for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.score for r in rows)


def test_point_axis_search(spark):
    rng = np.random.default_rng(6)
    ref = rng.normal(size=(400, 3)) * [1, 2, 0.5] + [1, 0, 2]
    cand = (rng.normal(size=(300, 3)) * [1, 2, 0.5] + [1, 0, 2])[:, [1, 2, 0]]
    qs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    rq = np.quantile(ref, qs, axis=0)
    scale = np.maximum(rq[4] - rq[2], 0.05)
    rc = np.cov(ref.T)
    rows = [(p.tolist(),) for p in ref] + [([float("nan"), 0.0, 0.0],)]
    got = ps.point_axis_search(spark.createDataFrame(rows[:400], "point array<double>"), spark.createDataFrame([(p.tolist(),) for p in cand], "point array<double>"), "point").collect()
    for r in got:
        x = transforms()[r.transform](cand)
        gap = np.mean(np.abs(np.quantile(x, qs, axis=0) - rq) / scale)
        cov = np.linalg.norm(np.cov(x.T) - rc) / max(np.linalg.norm(rc), 1e-6)
        assert (r.quantile_gap, r.covariance_gap, r.score) == pytest.approx((gap, cov, gap + 0.25 * cov), abs=1e-9)
    assert len(got) == 48 and min(got, key=lambda r: r.score)["rank"] == 1


def test_aligned_metrics_of_many_frames(spark):
    rng = np.random.default_rng(7)
    rows, errors = [], {"a": [], "b": []}
    for k in range(40):
        truth = rng.normal(size=(17, 3))
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        pred = (0.5 + rng.random()) * truth @ turn + rng.normal(size=3) + 0.05 * rng.normal(size=(17, 3))  # half are mirrored
        if k == 5:
            pred[:] = 1.0  # no extent: stays as it is
        rows.append(("ab"[k % 2], pred.tolist(), truth.tolist()))
        x, y = pred[BODY], truth[BODY]
        if k != 5:
            mx, my = x.mean(axis=0), y.mean(axis=0)
            u, s, vt = np.linalg.svd((x - mx).T @ (y - my))
            flip = np.ones(3)
            flip[2] = np.sign(np.linalg.det(u @ vt))
            x = s.sum() / ((x - mx) ** 2).sum() * (x - mx) @ (u * flip) @ vt + my
        errors["ab"[k % 2]].append(np.linalg.norm(x - y, axis=1).mean() * 1000)
    rows += [("a", [[float("nan")] * 3] * 17, rows[0][2]), ("a", None, rows[0][2])]
    got = {r.g: r for r in ps.pose_metrics(spark.createDataFrame(rows, f"g string, pred {POSE}, truth {POSE}"), ["g"], joints=BODY).collect()}
    for g, e in errors.items():
        assert got[g].frames == 20 and got[g].pa_mpjpe_mm == pytest.approx(np.mean(e), rel=1e-9)


def test_medians_and_far_points(spark):
    rng = np.random.default_rng(8)
    clouds = [rng.normal(size=(n, 5)) * (k % 3 + 1) for k, n in enumerate((1, 2, 3, 4, 5, 9, 20, 40))]
    clouds.append(np.tile([1.0, 2.0, 3.0, 0.0, 0.0], (6, 1)))
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(clouds)] + [(100, []), (101, None)], f"k long, points {POSE}")
    for r in df.select("k", ps.geometric_median("points").alias("m"), ps.farthest_points(4)("points").alias("f")).collect():
        if r.k >= 100:
            assert r.m is None and not r.f
            continue
        xyz = clouds[r.k][:, :3]
        total = lambda m: np.linalg.norm(xyz - m, axis=1).sum()
        m = np.array(r.m)
        near = m + 1e-3 * np.random.default_rng(1).normal(size=(200, 3))
        assert all(total(m) <= total(x) * (1 + 1e-4) for x in (*near, *xyz, xyz.mean(axis=0)))  # steps under 1e-5 end it
        rows = sorted(clouds[r.k].tolist())
        if len(rows) <= 4:
            assert r.f == rows
            continue
        p = np.array(rows)[:, :3]
        at = [int(np.linalg.norm(p - m, axis=1).argmin())]
        while len(at) < 4:
            gap = np.array([min(((p[i] - p[j]) ** 2).sum() for j in at) if i not in at else -1 for i in range(len(p))])
            at.append(int(gap.argmax()))
        assert r.f == [rows[i] for i in at]
