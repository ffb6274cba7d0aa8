"""Bounds of poses in the three target spaces, against numpy."""

import numpy as np
import pytest

from chronoweave.operators import pose as ps

SHIFT, SCALE = (0.1, 0.2, 0.3), 1.15


def expected(poses, anchors, mode):
    """The rules in numpy, for finite poses and anchors."""
    q = lambda x, p: np.quantile(x, p, axis=0)
    root = poses[:, :1]
    around = np.linalg.norm(poses - root, axis=2)
    shift = np.array(SHIFT)
    if mode == "absolute":
        r = np.maximum(q(around, 0.999) * SCALE * 1.1, 0.05)[:, None]
        return q(root[:, 0], 0.001) - r - shift, q(root[:, 0], 0.999) + r + shift
    r = np.maximum(q(around, 0.999) * SCALE * 1.1, 0.15)[:, None] * np.ones(3)
    low, high = -r, r
    if mode == "pelvis_relative":
        a, b = q(root[:, 0], 0.001), q(root[:, 0], 0.999)
        pad = np.maximum(0.1 * (b - a), 0.05) + shift
        low[0], high[0] = a - pad, b + pad
    else:
        far = max(np.quantile(np.linalg.norm(root[:, 0] - anchors, axis=1), 0.999) * SCALE * 1.1, 0.25)
        low[0], high[0] = -far, far
    return low, high


@pytest.mark.parametrize("spread", [0.4, 0.001])
@pytest.mark.parametrize("mode", ["absolute", "pelvis_relative", "cloud_anchor_relative"])
def test_bounds(spark, mode, spread):
    rng = np.random.default_rng(2)
    anchors = rng.normal(size=(400, 3)) * spread
    poses = anchors[:, None] + rng.normal(size=(400, 17, 3)) * spread + np.linspace(0, 1, 17)[:, None]
    rows = [(p.tolist(), a.tolist()) for p, a in zip(poses, anchors, strict=True)]
    broken = poses[0].copy()
    broken[3, 1] = np.nan
    rows += [(broken.tolist(), [0.0] * 3), (None, [0.0] * 3)]
    if mode == "cloud_anchor_relative":
        rows += [((poses[1] + 50).tolist(), None), ((poses[1] + 50).tolist(), [float("inf")] * 3)]
    df = spark.createDataFrame(rows, "pose array<array<double>>, anchor array<double>")
    bounds = ps.PoseBounds.of(ps.pose_bounds(df, "pose", mode, "anchor", SHIFT, SCALE))
    low, high = expected(poses, anchors, mode)
    np.testing.assert_allclose(bounds.low, low, atol=1e-9)
    np.testing.assert_allclose(bounds.high, high, atol=1e-9)


def test_bounds_are_checked(spark):
    fine = tuple((0.0, 0.0, 0.0) for _ in range(17))
    high = tuple((1.0, 1.0, 1.0) for _ in range(17))
    ps.PoseBounds(fine, high)
    for low, top in ((fine[:3], high[:3]), (fine, fine), (fine, (*high[:16], (1.0, float("inf"), 1.0)))):
        with pytest.raises(ValueError):
            ps.PoseBounds(low, top)
    with pytest.raises(ValueError):
        ps.PoseBounds.of(spark.createDataFrame([(0, 0, 0.0, 1.0)], "joint int, axis int, low double, high double"))
    with pytest.raises(ValueError):
        ps.pose_bounds(spark.createDataFrame([], "pose array<array<double>>"), "pose", "cloud_anchor_relative")


def test_report(spark):
    rng = np.random.default_rng(3)
    poses = rng.normal(size=(50, 17, 3))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(poses)], "frame long, pose array<array<double>>")
    table = spark.createDataFrame([(j, a, -1.0, 1.5) for j in range(17) for a in range(3)], "joint int, axis int, low double, high double")
    joints, frames = ps.bounds_report(df, "frame", "pose", table)
    for r in joints.collect():
        x = poses[:, r.joint, r.axis]
        assert (r.below, r.above, r.outside) == pytest.approx(((x < -1).mean(), (x > 1.5).mean(), ((x < -1) | (x > 1.5)).mean()))
    for r in frames.collect():
        assert r.frames_outside == pytest.approx(((poses[..., r.axis] < -1) | (poses[..., r.axis] > 1.5)).any(axis=1).mean())
