"""Placements of a domain: work that grows with the input alone, and the values of placements made one by one."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators import diagnostics as dg
from chronoweave.operators import pose as ps
from chronoweave.operators import scan
from chronoweave.operators import statistics as st

CLOUD = "array<array<double>>"
NAMES = ("sensor_as_recorded", "mounting_rotation_only", "mounting_rotation_and_height", "pose_template_rotation_only", "pose_template_rotation_and_translation")


def bodies(n, seed, turn=np.eye(3)):
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(0).normal(size=(17, 3))
    poses = (base + 0.1 * rng.normal(size=(n, 17, 3)) + rng.normal(size=(n, 1, 3))) @ turn
    points = rng.normal(size=(n, 4, 5)) + np.pad(poses[:, :1], ((0, 0), (0, 0), (0, 2)))
    return [[i, p.tolist(), q.tolist()] for i, (p, q) in enumerate(zip(points, poses, strict=True))]


def frames(spark, rows):
    return spark.createDataFrame(rows, f"frame long, points {CLOUD}, pose {CLOUD}")


def odd(rows):
    """Numbers that are missing, not finite or shared."""
    nan, inf = float("nan"), float("inf")
    rows[0][2][3][1], rows[1][2][8][0], rows[2][2][0][2], rows[3][2][5] = nan, inf, None, None
    rows[4][2], rows[5][1], rows[6][1] = None, None, []
    rows[7][2] = [[0.5, 0.5, 0.5]] * 17
    rows[8][1][0][1], rows[9][1][1] = None, [1.0, 2.0]
    return rows


def test_placements_do_not_repeat_rows(spark, monkeypatch):
    """Rows are written once, not once for each placement, and few of the values are put in order."""
    ordered, kept = [], []
    distribution, written = st.distribution, dg.written

    def counted(rows, *args, **more):
        ordered.append(rows.count())
        return distribution(rows, *args, **more)

    def seen(df, label):
        out = written(df, label)
        kept.append(out.count())
        return out

    for m in (st, ps):
        monkeypatch.setattr(m, "distribution", counted)
    monkeypatch.setattr(dg, "written", seen)
    n = 200
    reference, target = frames(spark, bodies(n, 1)), frames(spark, bodies(n, 2))
    assert dg.reference_frame_hypotheses(reference, target, "frame", "points", "pose").count() == 5
    many = n * (45 + 51 + 12 + 12)  # coordinates of a domain
    assert sum(ordered) < many and sum(kept) < 2 * n * (17 + 4 + 4) + 5_000


def test_placements_against_one_by_one(spark, monkeypatch):
    """Each placement's numbers as from a domain that was moved to it, with odd rows in both domains."""
    reference, target = frames(spark, odd(bodies(24, 1))), frames(spark, odd(bodies(21, 2, np.array(g.euler_rotation(0.3, -0.2, 0.5)).T)))
    found = {}
    for whole in (scan.WHOLE, 0):
        monkeypatch.setattr(scan, "WHOLE", whole)
        found[whole] = {r.hypothesis: r for r in dg.reference_frame_hypotheses(reference, target, "frame", "points", "pose").collect()}
    monkeypatch.undo()
    fitted, level = dg.kabsch_rotation(target, reference, "pose")[0], np.array(g.sensor_rotation()).T
    flat = lambda df, c, *own: df.select(*own, F.explode(c).alias("point"))
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])

    def moved(name, r, shift):
        place = lambda p: F.array(*[g.dot(F.transform(F.slice(p, 1, 3), lambda x: x.cast("double")), numbers(r[:, i])) + float(shift[i]) for i in range(3)])
        return target.select(F.lit(name).alias("k"), "frame", F.transform("points", place).alias("points"), F.transform("pose", place).alias("pose"))

    one = list(found.values())[0]
    every = reduce(DataFrame.unionByName, [moved(n, r, one[n].translation) for n, r in zip(NAMES, (np.eye(3), level, level, fitted, fitted), strict=True)])
    parts = [
        ps.pose_distances(reference, every, ["k"], "pose"),
        ps.point_distances(dg.root_centred_points(reference, [], "frame", "points", "pose"), dg.root_centred_points(every, ["k"], "frame", "points", "pose"), ["k"], "point"),
        *[ps.xyz_gaps(flat(reference, c), flat(every, c, "k"), ["k"], "point") for c in ("pose", "points")],
    ]
    pose, centred, joints, cloud = ({r.k: r for r in x.collect()} for x in parts)
    for got in found.values():
        assert sorted(got) == sorted(NAMES) and sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4, 5]
        for n, x in got.items():
            want = [pose[n].score, pose[n].median_gap, pose[n].iqr_gap, centred[n].score, centred[n].covariance_gap, joints[n].xyz_gap, cloud[n].xyz_gap, pose[n].score + centred[n].score]
            np.testing.assert_allclose([x.pose_score, x.pose_median_gap, x.pose_iqr_gap, x.point_score, x.point_covariance_gap, x.pose_xyz_gap, x.point_xyz_gap, x.composite_score], want, rtol=1e-9)
        for a, b in (NAMES[1:3], NAMES[3:]):
            assert got[a].composite_score == got[b].composite_score and got[min(a, b)]["rank"] + 1 == got[max(a, b)]["rank"]


@pytest.mark.parametrize("whole", [scan.WHOLE, 0])
def test_group_quantiles(spark, monkeypatch, whole):
    """numpy's quantiles, whatever lies in a group."""
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=3000), 1: np.r_[rng.normal(size=500), 1e300, -1e300], 2: np.full(50, 2.5), 3: np.array([7.0]), 4: rng.integers(0, 4, 400).astype(float), 5: np.array([-0.0, 0.0, 5e-324]), 6: np.array([-1.7e308, 1.7e308, 1.0])}
    none = [(k, x) for k in (0, 3, 9) for x in (None, float("nan"), float("inf"), -float("inf"))]
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + none, "k int, x double")
    monkeypatch.setattr(scan, "WHOLE", whole)
    qs = F.when(F.col("k") == 4, F.array(F.lit(0.5), F.lit(0.3))).otherwise(F.array(*map(F.lit, (0.0, 0.01, 0.25, 0.5, 0.99, 1.0))))
    got = {(r.k, r.q): r.value for r in st.group_quantiles(df, ["k"], "x", qs).collect()}
    want = {(k, q): v for k, v in groups.items() for q in ((0.5, 0.3) if k == 4 else (0.0, 0.01, 0.25, 0.5, 0.99, 1.0))}
    assert set(got) == set(want)
    for (k, q), v in want.items():
        if k != 6 or q in (0.0, 0.5, 1.0):  # elsewhere the distance of two neighbours is not finite
            np.testing.assert_allclose(got[k, q], np.quantile(v, q), rtol=1e-12)
