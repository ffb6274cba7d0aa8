"""Pose metrics and robust geometry; three Arrow functions where iteration or an SVD is needed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators.statistics import GAP, describe, distribution, minmax, paired_corr, percentiles, quantiles
from chronoweave.sources.shared import written

_POINTS = "array<array<double>>"


def weiszfeld(points: np.ndarray, tolerance: float = 1e-5, rounds: int = 64) -> np.ndarray | None:
    """Geometric median of the finite points: start at the coordinates' medians, snap to a point that is reached."""
    points = points[np.isfinite(points).all(axis=1)]
    if not len(points):
        return None
    here = np.median(points, axis=0)
    for _ in range(rounds if len(points) > 1 else 0):
        away = np.linalg.norm(points - here, axis=1)
        reached = np.flatnonzero(away <= tolerance)
        if len(reached):
            step = points[reached[0]]
        else:
            step = (points / away[:, None]).sum(axis=0) / (1 / away).sum()
        moved, here = np.linalg.norm(step - here), step
        if moved <= tolerance:
            break
    return here


def _cloud(points, columns: int = 3) -> np.ndarray:
    return np.array([p[:columns] for p in points], np.float64).reshape(-1, columns) if points is not None else np.empty((0, columns))


def geometric_median(cloud: str):
    """Geometric median of a cloud column's x, y, z, by an Arrow function; null without a finite point."""

    @F.pandas_udf("array<double>")
    def median(clouds: pd.Series) -> pd.Series:
        return pd.Series([None if (m := weiszfeld(_cloud(c))) is None else m.tolist() for c in clouds])

    return median(cloud)


def farthest_points(count: int):
    """An Arrow function: count points of each cloud, greedily far apart, from the one nearest the geometric median.

    Points are first put in canonical order, so equal sets give equal samples; smaller clouds stay whole.
    """

    @F.pandas_udf(_POINTS)
    def pick(clouds: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in clouds:
            out = []
            for cloud in series:
                rows = sorted(map(list, cloud)) if cloud is not None else []
                if len(rows) > count:
                    xyz = _cloud(rows)
                    at = [int(np.argmin(np.linalg.norm(xyz - weiszfeld(xyz), axis=1)))]
                    near = ((xyz - xyz[at[0]]) ** 2).sum(axis=1)
                    near[at] = -1
                    while len(at) < count:
                        at.append(int(np.argmax(near)))
                        near = np.minimum(near, ((xyz - xyz[at[-1]]) ** 2).sum(axis=1))
                        near[at] = -1
                    rows = [rows[i] for i in at]
                out.append(rows)
            yield pd.Series(out)

    return pick


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that take rows of x nearest to rows of y."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    return _similarity((x - mx).T @ (y - my), float(((x - mx) ** 2).sum()), mx, my)


def _similarity(cross: np.ndarray, spread: float, mx: np.ndarray, my: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(cross)
    rotation = u @ vt
    if np.linalg.det(rotation) < 0:
        vt[-1] *= -1
        rotation = u @ vt
    scale = float(s.sum() / max(spread, 1e-12))
    return scale, rotation, my - scale * mx @ rotation


def aligned_pose(joints: Sequence[int]):
    """An Arrow function: each prediction aligned to its truth by the similarity of some joints."""

    @F.pandas_udf(_POINTS)
    def align(pred: pd.Series, truth: pd.Series) -> pd.Series:
        out, ids = [], list(joints)
        for p, t in zip(pred, truth, strict=True):
            x, y = _cloud(p), _cloud(t)
            a, b = x[ids] - x[ids].mean(axis=0), y[ids] - y[ids].mean(axis=0)
            if np.linalg.norm(a) >= 1e-9 and np.linalg.norm(b) >= 1e-9:
                scale, rotation, shift = similarity(x[ids], y[ids])
                x = scale * x @ rotation + shift
            out.append(x.tolist())
        return pd.Series(out)

    return align


def apply_similarity(pose, transform: tuple[float, np.ndarray, np.ndarray]):
    scale, rotation, shift = transform
    return g.each(pose, lambda j: g.rigid(j, (scale * rotation).T.tolist(), shift.tolist()))


def finite_pose(pose):
    return F.coalesce(F.forall(pose, lambda j: F.forall(j, g.is_finite)), F.lit(False))


def pose_metrics(frames: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", joints: Sequence[int] = tuple(range(17)), aligned: bool = True) -> DataFrame:
    """Joint errors in mm over frames whose poses are finite: mean, median, root-relative, aligned; shares within 50, 100, 150 mm."""
    rows = frames.where(finite_pose(F.col(pred)) & finite_pose(F.col(truth)))
    if aligned:
        rows = rows.withColumn("_aligned", aligned_pose(joints)(pred, truth))
    parts = [F.col(pred).alias("p"), F.col(truth).alias("t"), F.col("_aligned").alias("a")][: 2 + aligned]
    # a row for each joint, then scalar arithmetic: it stays in generated code
    long = rows.select(*keys, g.at(F.col(pred), 0).alias("p0"), g.at(F.col(truth), 0).alias("t0"), F.posexplode(F.arrays_zip(*parts)).alias("joint", "x")).where(F.col("joint").isin(*joints))
    at = lambda c, i: g.at(F.col(c), i).cast("double")
    apart = lambda u, v: F.sqrt(sum((x * x for x in [u(i) - v(i) for i in range(3)]), F.lit(0.0)))
    error, root = apart(lambda i: at("x.p", i), lambda i: at("x.t", i)), apart(lambda i: at("x.p", i) - at("p0", i), lambda i: at("x.t", i) - at("t0", i))
    rest = apart(lambda i: at("x.a", i), lambda i: at("x.t", i)) if aligned else F.lit(None).cast("double")
    long = long.select(*keys, error.alias("e"), root.alias("r"), rest.alias("a"))
    share = lambda limit: F.avg((F.col("e") <= limit).cast("double"))
    out = long.groupBy(keys).agg(
        F.round(F.count("*") / len(joints)).cast("long").alias("frames"), (F.avg("e") * 1000).alias("mpjpe_mm"), (F.avg("r") * 1000).alias("root_relative_mpjpe_mm"),
        (F.avg("a") * 1000).alias("pa_mpjpe_mm"), share(0.05).alias("pck_50mm"), share(0.10).alias("pck_100mm"), share(0.15).alias("pck_150mm"),
    )
    median = quantiles(distribution(long, keys, "e"), keys, (0.5,)).select(*keys, (F.col("value") * 1000).alias("median_joint_error_mm"))
    return out.join(median, keys) if keys else out.join(F.broadcast(median))  # without keys: one row


def global_similarity(frames: DataFrame, pred: str = "pred", truth: str = "truth", joints: Sequence[int] = tuple(range(17))) -> tuple[float, np.ndarray, np.ndarray]:
    """One similarity over the pooled finite joints of all frames: sums in Spark, a 3 by 3 SVD on the driver."""
    pairs = frames.select(F.explode(F.array(*[F.struct(F.slice(g.at(F.col(pred), j), 1, 3).alias("x"), F.slice(g.at(F.col(truth), j), 1, 3).alias("y")) for j in joints])).alias("j")).select("j.*")
    pairs = pairs.where(F.forall("x", g.is_finite) & F.forall("y", g.is_finite) & (F.size("x") == 3) & (F.size("y") == 3))
    x, y = [g.at(F.col("x"), i) for i in range(3)], [g.at(F.col("y"), i) for i in range(3)]
    mean = pairs.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{s}{i}") for s, cs in (("x", x), ("y", y)) for i, c in enumerate(cs)]).first()
    if mean["n"] < 3:
        raise ValueError("not enough valid joints for a similarity")
    mx, my = (np.array([mean[f"{s}{i}"] for i in range(3)]) for s in "xy")
    sums = [F.sum((x[i] - float(mx[i])) * (y[j] - float(my[j]))).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    got = pairs.agg(*sums, F.sum(sum(((x[i] - float(mx[i])) * (x[i] - float(mx[i])) for i in range(3)), F.lit(0.0))).alias("s")).first()
    return _similarity(np.array([[got[f"c{i}{j}"] for j in range(3)] for i in range(3)]), got["s"], mx, my)


def joint_values(frames: DataFrame, keys: list[str], pose: str) -> DataFrame:
    """Long form: keys, joint, axis, value, relative (to the root)."""
    both = F.posexplode(F.arrays_zip(F.col(pose).alias("p"), g.root_relative(F.col(pose)).alias("r"))).alias("joint", "z")
    rows = frames.select(*keys, both)
    return rows.select(*keys, "joint", F.posexplode(F.arrays_zip(F.slice("z.p", 1, 3).alias("value"), F.col("z.r").alias("relative"))).alias("axis", "v")).select(*keys, "joint", "axis", "v.value", "v.relative")


def joint_statistics(frames: DataFrame, keys: list[str], pose: str) -> DataFrame:
    """describe of every joint and axis, absolute and root-relative."""
    long = joint_values(frames, keys, pose)
    group = [*keys, "joint", "axis"]
    stacked = long.select(*group, F.lit("absolute").alias("frame"), "value").unionByName(long.select(*group, F.lit("root_relative").alias("frame"), F.col("relative").alias("value")))
    return describe(stacked, [*group, "frame"], "value")


@dataclass(frozen=True)
class PoseBounds:
    """Least and largest coordinates of each joint in a target space, checked."""

    low: tuple[tuple[float, ...], ...]
    high: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        low, high = (np.array(x, dtype=float) for x in (self.low, self.high))
        if low.shape != (g.JOINTS, 3) or high.shape != (g.JOINTS, 3):
            raise ValueError(f"bounds must be {g.JOINTS} joints of 3 numbers, not {low.shape} and {high.shape}")
        if not (np.isfinite(low).all() and np.isfinite(high).all()):
            raise ValueError("bounds must be finite")
        if (high <= low).any():
            raise ValueError("every high bound must be over its low one")

    @classmethod
    def of(cls, table: DataFrame) -> PoseBounds:
        """From the rows that pose_bounds gives: one for each joint and axis."""
        rows = {(r["joint"], r["axis"]): (r["low"], r["high"]) for r in table.collect()}
        side = lambda k: tuple(tuple(rows[j, a][k] if (j, a) in rows else float("nan") for a in range(3)) for j in range(g.JOINTS))
        return cls(side(0), side(1))


def pose_bounds(frames: DataFrame, pose: str, mode: str = "absolute", anchor: str | None = None, translation: Sequence[float] = (0.0, 0.0, 0.0), body_scale: float = 1.0, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """joint, axis, low, high: bounds of the poses in a target space (see encode_target), that rotations, mirroring, scaling
    up to body_scale and shifts up to translation do not leave.

    Poses (and anchors, where the mode needs them) that are not finite are left out. The
    pelvis takes its outer quantiles, widened by a tenth of their span or 5 cm and by the translation;
    relative to an anchor, the outer radius around it, 25 cm at least. Other joints take their
    outer radius around the pelvis, 15 cm at least. Absolute joints take the pelvis's
    quantiles, widened by each joint's radius, 5 cm at least, and the translation.
    """
    whole = F.forall(F.col(pose), lambda j: F.forall(j, g.is_finite))
    if mode == "cloud_anchor_relative":
        if anchor is None:
            raise ValueError("bounds relative to an anchor need the anchors' column")
        whole = whole & F.coalesce(F.forall(F.col(anchor), g.is_finite), F.lit(False))
    rows = frames.where(F.coalesce(whole, F.lit(False)))
    rows = rows.select(g.encode_target(F.col(pose), mode, F.col(anchor) if anchor else None).alias("_encoded"), F.col(pose).alias("_pose"))
    many = 3 * g.JOINTS * frames.count()
    shift = F.element_at(F.array(*[F.lit(float(t)) for t in translation]), F.col("axis") + 1)
    number = F.col("value").cast("double")

    each = rows.select(F.posexplode("_encoded").alias("joint", "_j")).select("joint", F.posexplode("_j").alias("axis", "value"))
    ends = percentiles(each, ["joint", "axis"], {"a": (number, low), "b": (number, high)}, [many])
    # radius around the pelvis; of the pelvis itself around the anchor
    centre = g.at(F.col("_pose"), 0)
    away = F.when(F.col("joint") == 0, g.norm(g.at(F.col("_encoded"), 0)) if mode == "cloud_anchor_relative" else F.lit(0.0)).otherwise(g.norm(g.minus(F.col("_j"), centre)))
    radii = rows.select("_encoded", "_pose", F.posexplode("_pose").alias("joint", "_j")).select("joint", away.alias("value"))
    radii = percentiles(radii, ["joint"], {"r": (number, high)}, [many]).withColumn("r", F.col("r") * body_scale * 1.1)
    both = ends.join(F.broadcast(radii), "joint")  # a row for each joint
    root = ends.where("joint = 0").select("axis", F.col("a").alias("ra"), F.col("b").alias("rb"))
    both = both.join(F.broadcast(root), "axis")  # three rows
    if mode == "absolute":
        radius = F.greatest("r", F.lit(0.05))
        return both.select("joint", "axis", (F.col("ra") - radius - shift).alias("low"), (F.col("rb") + radius + shift).alias("high"))
    pad = F.greatest((F.col("b") - F.col("a")) * 0.1, F.lit(0.05)) + shift
    first = (F.col("joint") == 0) & F.lit(mode == "pelvis_relative")
    radius = F.greatest("r", F.when(F.col("joint") == 0, 0.25).otherwise(0.15))
    return both.select("joint", "axis", F.when(first, F.col("a") - pad).otherwise(-radius).alias("low"), F.when(first, F.col("b") + pad).otherwise(radius).alias("high"))


def bounds_report(frames: DataFrame, frame_id: str, pose: str, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares below, above and outside per joint and axis; and per axis the share of frames with any joint outside."""
    long = joint_values(frames, [frame_id], pose).join(F.broadcast(bounds), ["joint", "axis"])  # 51 rows
    below, above = F.col("value") < F.col("low"), F.col("value") > F.col("high")
    share = lambda c: F.avg(c.cast("double"))
    per_joint = long.groupBy("joint", "axis").agg(share(below).alias("below"), share(above).alias("above"), share(below | above).alias("outside"))
    any_joint = long.groupBy(frame_id, "axis").agg(F.bool_or(below | above).alias("any")).groupBy("axis").agg(share(F.col("any")).alias("frames_outside"))
    return per_joint, any_joint


def median_template(frames: DataFrame, keys: list[str], pose: str) -> DataFrame:
    """keys, joint, axis, value: medians of the normalised shapes."""
    shaped = frames.withColumn("_s", g.normalised_shape(F.col(pose)))
    long = joint_values(shaped, keys, "_s")
    group = [*keys, "joint", "axis"]
    return quantiles(distribution(long, group, "value"), group, (0.5,)).drop("q")


def theil_sen_anchor(anchors: DataFrame, keys: list[str], time: str = "relative_time", anchor: str = "anchor") -> DataFrame:
    """keys, axis, value: robust position at time 0 of a window's per-frame anchors.

    Median of the pairwise slopes, then median of what it leaves; windows are a few frames.
    """
    long = anchors.select(*keys, F.col(time).alias("t"), F.posexplode(F.slice(anchor, 1, 3)).alias("axis", "y")).where(g.is_finite(F.col("y")))
    group = [*keys, "axis"]
    a, b = long.select(*group, F.col("t").alias("t1"), F.col("y").alias("y1")), long.select(*group, F.col("t").alias("t2"), F.col("y").alias("y2"))
    slopes = a.join(b, group).where("t2 - t1 > 1e-12").groupBy(group).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("t2") - F.col("t1"))).alias("slope"))
    rest = long.join(slopes, group, "left").withColumn("r", F.col("y") - F.coalesce("slope", F.lit(0.0)) * F.col("t"))
    return rest.groupBy(group).agg(F.median("r").alias("value"))


def cloud_centroid(frames: DataFrame, keys: list[str], points: str) -> DataFrame:
    """keys, centroid: medians of a frame's finite coordinates; null where a frame has none."""
    median = lambda i: _array_median(F.filter(F.transform(g.points_or_empty(F.col(points)), lambda p: g.at(p, i)), g.is_finite))
    return frames.select(*keys, F.array(*[median(i) for i in range(3)]).alias("centroid"))


def _array_median(a):
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def skeleton_distances(rows: DataFrame, key: list[str], point: str, pose: str) -> DataFrame:
    """key, d: distance of each point to the nearest limb of its pose.

    A row for each limb, scalar arithmetic, then the least: it stays in generated code.
    """
    limbs = F.array(*[F.struct(g.at(F.col(pose), a).alias("a"), g.at(F.col(pose), b).alias("b")) for a, b in g.LIMBS])
    long = rows.select(*key, F.slice(point, 1, 3).alias("p"), F.explode(limbs).alias("l"))
    scalars = {f"{n}{i}": g.at(F.col(c), i).cast("double") for n, c in (("p", "p"), ("a", "l.a"), ("b", "l.b")) for i in range(3)}
    long = long.select(*key, *[c.alias(n) for n, c in scalars.items()])
    ab, ap = [F.col(f"b{i}") - F.col(f"a{i}") for i in range(3)], [F.col(f"p{i}") - F.col(f"a{i}") for i in range(3)]
    total = lambda xs: xs[0] + xs[1] + xs[2]
    length = total([x * x for x in ab])
    t = F.when(length < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total([x * y for x, y in zip(ap, ab, strict=True)]) / length)))
    long = long.withColumn("t", t)
    rest = [y - F.col("t") * x for x, y in zip(ab, ap, strict=True)]
    return long.withColumn("d", F.sqrt(total([x * x for x in rest]))).groupBy(key).agg(F.min("d").alias("d"))


def axis_table(spark) -> DataFrame:
    """The 48 signed axis permutations as a table."""
    return spark.createDataFrame([(n, list(p), list(map(float, s)), d) for n, p, s, d in g.axis_transforms()], "transform string, perm array<int>, signs array<double>, determinant int")


def signed_axes(spark) -> DataFrame:
    """transform, determinant, axis, source, sign: what each axis of the 48 transforms is made of, 144 rows."""
    rows = [(n, d, i, p[i], float(s[i])) for n, p, s, d in g.axis_transforms() for i in range(3)]
    return spark.createDataFrame(rows, "transform string, determinant int, axis int, source int, sign double")


def three(point):
    """The first three numbers of a point as doubles; null where there are fewer."""
    return F.array(*[g.at(point, i).cast("double") for i in range(3)])


def axis_quartiles(translation: dict[int, Sequence[float]]):
    """An Arrow function of flat clouds and poses: for each axis transform the lower quartile of a cloud's distances to
    the nearest limb of the transformed pose, moved by that transform's translation; null for an empty cloud."""
    ends = np.array(g.LIMBS).T
    perms, signs, moves = np.array([t[1] for t in g.axis_transforms()]), np.array([t[2] for t in g.axis_transforms()], float), np.array([translation[t] for t in range(48)])

    def distances(points: np.ndarray, pose: np.ndarray) -> np.ndarray:
        at = pose[:, perms].transpose(1, 0, 2) * signs[:, None] + moves[:, None]  # transforms, joints, axes
        a, b = at[:, ends[0]], at[:, ends[1]]
        ab = b - a
        total = lambda x: x[0] + x[1] + x[2]
        ab = [ab[:, None, :, i] for i in range(3)]
        ap = [points[None, :, None, i] - a[:, None, :, i] for i in range(3)]
        length = total([x * x for x in ab])
        t = total([x * y for x, y in zip(ap, ab, strict=True)]) / np.where(length < 1e-12, 1.0, length)
        t = np.where(length < 1e-12, 0.0, np.clip(t, 0.0, 1.0))
        rest = [y - t * x for x, y in zip(ab, ap, strict=True)]
        return np.sqrt(np.fmin.reduce(total([x * x for x in rest]), axis=2))

    @F.pandas_udf("array<double>")
    def quartiles(clouds: pd.Series, poses: pd.Series) -> pd.Series:
        out = []
        for cloud, pose in zip(clouds, poses, strict=True):
            points = np.asarray(cloud, float).reshape(-1, 3)
            if not len(points):
                out.append(None)
                continue
            pose = np.asarray(pose, float).reshape(-1, 3)
            # a few points at once, however large the cloud
            with np.errstate(invalid="ignore"):
                d = np.sort(np.concatenate([distances(points[i : i + 256], pose) for i in range(0, len(points), 256)], axis=1), axis=1)
            place = 0.25 * (len(points) - 1)
            low, high = d[:, int(place)], d[:, min(int(place) + 1, len(points) - 1)]
            part = place - int(place)
            out.append((low if part == 0 else low + (high - low) * part).tolist())
        return pd.Series(out)

    return quartiles


def axis_search(frames: DataFrame, frame_id: str, points: str, pose: str) -> DataFrame:
    """Ranks the 48 axis transforms of poses by how well they meet the frames' clouds.

    Composite of the root-to-centroid residual (0.45), the frames' lower quartile of
    distances to the skeleton (0.45) and the axes' correlation (0.1), each min-max scaled.

    An axis of a transformed root is one of three axes with one of two signs, so residuals and
    correlations are those of 18 pairs of axes; only the distances to the skeleton are taken for
    each transform, all 48 of a frame together.
    """
    spark = frames.sparkSession
    base = cloud_centroid(frames, [frame_id, points, pose], points)
    base = base.withColumn("_root", three(g.at(F.col(pose), 0))).where(F.forall("centroid", g.is_finite) & F.forall("_root", g.is_finite))
    flat = lambda c: F.flatten(F.transform(g.points_or_empty(F.col(c)), three))
    # a point without three numbers has no distance
    whole = F.filter(F.transform(g.points_or_empty(F.col(points)), three), lambda p: F.forall(p, lambda x: x.isNotNull()))
    base = written(base.select(frame_id, "centroid", "_root", F.flatten(whole).alias("_points"), flat(pose).alias("_pose")), "axis-frames")
    n = base.count()
    axes, group = signed_axes(spark), ["transform", "determinant"]
    own = ["axis", "source", "sign"]
    pairs = [F.struct(F.lit(i).alias("axis"), F.lit(j).alias("source"), F.lit(float(s)).alias("sign"), g.at(F.col("centroid"), i).alias("c"), (g.at(F.col("_root"), j) * float(s)).alias("r")) for i in range(3) for j in range(3) for s in (1, -1)]
    pairs = base.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").withColumn("gap", F.col("c") - F.col("r"))
    shift = written(percentiles(pairs, own, {"shift": (F.col("gap"), 0.5)}, [18 * n]), "axis-shifts")
    residual = pairs.join(F.broadcast(shift), own).groupBy(own).agg(F.sum(F.pow(F.col("shift") - F.col("gap"), 2.0)).alias("residual"))  # 18 rows
    counted = base.agg(F.countDistinct(frame_id).alias("frames"))
    rmse = axes.join(residual, own).groupBy(group).agg(F.sum("residual").alias("residual")).join(F.broadcast(counted))
    rmse = rmse.select(*group, F.sqrt(F.col("residual") / F.col("frames")).alias("root_centroid_rmse"), "frames")
    corr = axes.join(paired_corr(pairs, own, "r", "c"), own).groupBy(group).agg(F.avg("corr").alias("axis_correlation"))
    move = axes.join(shift, own).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("axis", "shift"))).alias("m")).select(*group, F.array(*[F.col("m")[i] for i in range(3)]).alias("translation"))
    moves = {r["transform"]: r["translation"] for r in move.collect()}  # 48 rows
    names = [t[0] for t in g.axis_transforms()]
    q25 = base.limit(0).select(F.lit(0).alias("number"), F.lit(0.0).alias("q"))
    if moves:
        q25 = base.select(F.posexplode(axis_quartiles({i: moves[t] for i, t in enumerate(names)})("_points", "_pose")).alias("number", "q"))
    q25 = percentiles(q25, ["number"], {"skeleton_q25": (F.col("q"), 0.5)}, [48 * n])
    q25 = q25.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "number int, transform string")), "number").drop("number")
    out = rmse.join(corr, group, "left").join(q25, "transform", "left").join(move, group)
    out = out.select(*group, "root_centroid_rmse", "frames", "axis_correlation", "skeleton_q25", "translation")
    for c, reverse in (("root_centroid_rmse", False), ("skeleton_q25", False), ("axis_correlation", True)):
        out = minmax(out, [], c, reverse, f"_{c}")
    out = out.withColumn("composite_score", 0.45 * F.col("_root_centroid_rmse") + 0.45 * F.col("_skeleton_q25") + 0.1 * F.col("_axis_correlation"))
    return ranked(out.drop("_root_centroid_rmse", "_skeleton_q25", "_axis_correlation"), "composite_score", "transform")


def ranked(scores: DataFrame, score: str, *ties: str) -> DataFrame:
    """A small table of scored candidates with rank 1 for the least score."""
    from pyspark.sql import Window as W

    return scores.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(score).asc_nulls_last(), *ties)))


def shape_spread(df: DataFrame, keys: list[str], pose: str) -> DataFrame:
    """keys, joint, axis, m, iqr: median and IQR (at least 1e-6) of the body joints of normalised shapes."""
    long = joint_values(df.withColumn("_s", g.normalised_shape(F.col(pose))), keys, "_s").where(F.col("joint").isin(*g.BODY15))
    group = [*keys, "joint", "axis"]
    q = quantiles(distribution(long, group, "value"), group, (0.25, 0.5, 0.75)).groupBy(group)
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    return q.agg(pick(0.5).alias("m"), F.greatest(pick(0.75) - pick(0.25), F.lit(1e-6)).alias("iqr"))


def pose_distances(reference: DataFrame, candidates: DataFrame, keys: list[str], pose: str) -> DataFrame:
    """keys, median_gap, iqr_gap, score: how far each group's shapes lie from the reference's distribution.

    Mean gap of the joints' medians over the reference's IQR (at least 0.05), plus 0.35
    of the mean absolute log ratio of the IQRs, on the body joints.
    """
    return _shape_gaps(shape_spread(reference, [], pose), shape_spread(candidates, keys, pose), keys)


def _shape_gaps(reference: DataFrame, spreads: DataFrame, keys: list[str]) -> DataFrame:
    """pose_distances of spreads that are known."""
    ref = reference.select("joint", "axis", F.col("m").alias("rm"), F.col("iqr").alias("ri"))
    both = spreads.join(F.broadcast(ref), ["joint", "axis"])  # 45 rows
    gap = F.avg(F.abs(F.col("m") - F.col("rm")) / F.greatest(F.col("ri"), F.lit(0.05)))
    log = F.avg(F.abs(F.log((F.col("iqr") + 1e-4) / (F.col("ri") + 1e-4))))
    return both.groupBy(keys).agg(gap.alias("median_gap"), log.alias("iqr_gap")).withColumn("score", F.col("median_gap") + 0.35 * F.col("iqr_gap"))


def xyz_gaps(reference: DataFrame, candidates: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, xyz_gap: mean absolute difference of seven quantiles of each coordinate, over the reference's IQR (at least 0.05).

    A point a row; points count where all three coordinates are finite.
    """
    return _quantile_gaps(_cut(reference, [], point), _cut(candidates, keys, point), keys)


def _cut(df: DataFrame, own: list[str], point: str) -> DataFrame:
    """own, axis, q, value: seven quantiles of each coordinate."""
    whole = df.where(F.forall(F.slice(point, 1, 3), g.is_finite))
    long = whole.select(*own, F.posexplode(F.slice(point, 1, 3)).alias("axis", "value"))
    return quantiles(distribution(long, [*own, "axis"], "value"), [*own, "axis"], GAP)


def _quantile_gaps(reference: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """xyz_gaps of quantiles that are known."""
    iqr = F.max(F.when(F.col("q") == 0.75, F.col("value"))) - F.max(F.when(F.col("q") == 0.25, F.col("value")))
    ref = reference.select("axis", "q", F.col("value").alias("rv")).join(reference.groupBy("axis").agg(F.greatest(iqr, F.lit(0.05)).alias("scale")), "axis")
    return cuts.join(F.broadcast(ref), ["axis", "q"]).groupBy(keys).agg(F.avg(F.abs(F.col("value") - F.col("rv")) / F.col("scale")).alias("xyz_gap"))  # 21 rows


def _covariances(df: DataFrame, own: list[str], point: str) -> DataFrame:
    x = [g.at(F.col(point), i) for i in range(3)]
    return df.groupBy(own).agg(F.array(*[F.covar_samp(a, b) for a in x for b in x]).alias("cov"))


def point_distances(reference: DataFrame, candidates: DataFrame, keys: list[str], point: str) -> DataFrame:
    """keys, quantile_gap, covariance_gap, score: quantile gap plus 0.25 of the covariance gap, a point a row."""
    return _point_gaps(_covariances(reference, [], point), _covariances(candidates, keys, point), xyz_gaps(reference, candidates, keys, point), keys)


def _point_gaps(reference: DataFrame, covariances: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """point_distances of covariances and quantile gaps that are known."""
    both = covariances.join(F.broadcast(reference.withColumnRenamed("cov", "rcov")))  # one row
    frob = g.norm(F.zip_with("cov", "rcov", lambda a, b: a - b)) / F.greatest(g.norm(F.col("rcov")), F.lit(1e-6))
    return both.select(*keys, frob.alias("covariance_gap")).join(gaps.withColumnRenamed("xyz_gap", "quantile_gap"), keys).withColumn("score", F.col("quantile_gap") + 0.25 * F.col("covariance_gap"))


def pose_axis_search(reference: DataFrame, candidate: DataFrame, pose: str) -> DataFrame:
    """Ranks the axis transforms of candidate poses by the distance of their shapes' distribution to the reference's.

    A transform permutes and signs the axes of a shape and leaves its scale alone, so medians and IQRs
    of all 48 are those of the poses as they are, under the same axes and signs.
    """
    group = ["transform", "determinant"]
    as_is = written(shape_spread(candidate.withColumn(pose, F.transform(pose, three)), [], pose).withColumnRenamed("axis", "source"), "shape-spread")  # 45 rows
    moved = as_is.join(F.broadcast(signed_axes(candidate.sparkSession)), "source").select(*group, "joint", "axis", (F.col("m") * F.col("sign")).alias("m"), "iqr")
    return ranked(_shape_gaps(shape_spread(reference, [], pose), moved, group), "score", "transform")


def point_axis_search(reference: DataFrame, candidate: DataFrame, point: str) -> DataFrame:
    """Ranks the axis transforms of candidate points by the distance of their distribution to the reference's, one point a row.

    Quantiles and covariances of all 48 are those of the points as they are: a signed axis has the
    negated quantiles from the other end, a pair of axes the covariance under both signs.
    """
    group, axes = ["transform", "determinant"], signed_axes(candidate.sparkSession)
    candidate = candidate.withColumn(point, three(F.col(point)))
    cuts = written(_cut(candidate, [], point).withColumnRenamed("axis", "source"), "point-quantiles")  # 21 rows
    other = F.element_at(F.create_map(*[F.lit(x) for pair in zip(GAP, reversed(GAP), strict=True) for x in pair]), F.col("q"))
    moved = cuts.join(F.broadcast(axes), "source").select(*group, "axis", F.when(F.col("sign") < 0, other).otherwise(F.col("q")).alias("q"), (F.col("value") * F.col("sign")).alias("value"))
    table = axis_table(candidate.sparkSession)
    pairs = F.array(*[F.get(F.col("cov"), g.at(F.col("perm"), i) * 3 + g.at(F.col("perm"), j)) * g.at(F.col("signs"), i) * g.at(F.col("signs"), j) for i in range(3) for j in range(3)])
    cov = _covariances(candidate, [], point).join(F.broadcast(table)).select(*group, pairs.alias("cov"))
    return ranked(_point_gaps(_covariances(reference, [], point), cov, _quantile_gaps(_cut(reference, [], point), moved, group), group), "score", "transform")
