"""Comparison of two recording domains: frame geometry, signal, model features, reference frames.

Points are rows or arrays of x, y, z, Doppler, signal; poses are arrays of 17 joints.
`keys` name the domain; everything is a distributed aggregate over it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators import pose as ps
from chronoweave.operators import statistics as st
from chronoweave.operators.frames import _drawn, drawn, frame_quotas, matched_sample
from chronoweave.sources.shared import written

#: Limits of the model's features, by group: divisor and clip.
FEATURE_LIMITS = {"absolute": (4.0, 2.0), "centred": (2.0, 2.0), "doppler": (3.0, 2.0), "signal_robust": (None, 5.0)}
POINT_VARIABLES = ("range", "abs_doppler", "x", "y", "z")
FRAME_VARIABLES = ("point_count", "range_median_m", "doppler_abs_median_mps")


def _median_of(values: Column) -> Column:
    return g.bound(F.array_sort(F.filter(values, g.is_finite)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def frame_geometry(frames: DataFrame, keys: list[str], frame_id: str, points: str, pose: str, maximum: int | None = None, seed: int = 0) -> DataFrame:
    """A row for each frame: cloud centroid, pelvis, their offset, distances to the skeleton, bone lengths, medians.

    maximum: so many points of a frame, by a hash, enter the distances; all by default.
    """
    column = lambda i: F.transform(points, lambda p: g.at(p, i).cast("double"))
    root = g.at(F.col(pose), 0)
    bones = F.array(*[g.distance(g.at(F.col(pose), a), g.at(F.col(pose), b)) for a, b in g.LIMBS])
    out = frames.select(
        *keys, frame_id, F.size(points).cast("long").alias("point_count"),
        *[_median_of(column(i)).alias(f"cloud_centroid_{n}_m") for i, n in enumerate("xyz")], *[g.at(root, i).cast("double").alias(f"pelvis_{n}_m") for i, n in enumerate("xyz")],
        g.distance(g.at(F.col(pose), 8), root).alias("pelvis_to_neck_m"), _median_of(bones).alias("median_bone_length_m"), _median_of(column(4)).alias("return_signal_median"),
        _median_of(F.transform(points, lambda p: F.abs(g.at(p, 3)).cast("double"))).alias("doppler_abs_median_mps"),
        _median_of(F.transform(points, lambda p: g.norm(F.slice(p, 1, 3)))).alias("range_median_m"),
    )
    out = out.withColumns({f"centroid_minus_pelvis_{n}_m": F.col(f"cloud_centroid_{n}_m") - F.col(f"pelvis_{n}_m") for n in "xyz"})
    each = frames.select(*keys, frame_id, F.col(pose).alias("_pose"), F.posexplode(points).alias("_at", "_p"))
    if maximum:
        order = st.W.partitionBy(*keys, frame_id).orderBy(_drawn(seed, [frame_id, "_at"]), "_at")
        each = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= maximum).drop("_r")
    near = ps.skeleton_distances(each, [*keys, frame_id, "_at"], "_p", "_pose").groupBy(*keys, frame_id).agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.5))).alias("_q"))
    near = near.select(*keys, frame_id, F.get("_q", F.lit(0)).alias("point_to_skeleton_p25_m"), F.get("_q", F.lit(1)).alias("point_to_skeleton_p50_m"))
    return out.join(near, [*keys, frame_id], "left")


def offset_summary(geometry: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, median_m, iqr_m, frames of the centroids' offsets from the pelvis."""
    long = geometry.select(*keys, F.posexplode(F.array(*[F.col(f"centroid_minus_pelvis_{n}_m") for n in "xyz"])).alias("axis", "v"))
    q = st.quantiles(st.distribution(long, [*keys, "axis"], "v"), [*keys, "axis"], (0.25, 0.5, 0.75)).groupBy(*keys, "axis")
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    out = q.agg(pick(0.5).alias("median_m"), (pick(0.75) - pick(0.25)).alias("iqr_m"))
    frames = geometry.groupBy(keys).agg(F.count("*").alias("frames"))
    return out.join(frames, keys) if keys else out.join(F.broadcast(frames))  # without keys: one row


def root_centred_points(frames: DataFrame, keys: list[str], frame_id: str, points: str, pose: str, maximum: int | None = None, seed: int = 0) -> DataFrame:
    """keys, frame_id, point: points minus the frame's pelvis.

    If a maximum is given, each frame gives its share of it at random, one point at least,
    and of these at most the maximum are drawn for each domain.
    """
    each = frames.select(*keys, frame_id, g.at(F.col(pose), 0).alias("_root"), F.posexplode(points).alias("_at", "_p"))
    if maximum:
        share = frames.groupBy(keys).agg(F.greatest(F.lit(1), F.ceil(F.lit(maximum) / F.count("*"))).alias("_per"))
        each = each.join(F.broadcast(share), keys) if keys else each.join(F.broadcast(share))  # a row for each domain
        order = st.W.partitionBy(*keys, frame_id).orderBy(_drawn(seed, [frame_id, "_at"]), "_at")
        each = each.withColumn("_r", F.row_number().over(order)).where("_r <= _per")
        each = drawn(each, keys, [frame_id, "_at"], maximum, seed + 1)
    return each.select(*keys, frame_id, g.minus(F.col("_p"), F.col("_root")).alias("point"))


def feature_statistics(frames: DataFrame, keys: list[str], points: str, pose: str) -> DataFrame:
    """keys, feature and a description: range, Doppler and signal of the points, coordinates of points and joints."""
    each = frames.select(*keys, F.explode(points).alias("p"))
    named = {"range": g.norm(F.slice("p", 1, 3)), "doppler": g.at(F.col("p"), 3), "signal": g.at(F.col("p"), 4), **{f"point_{n}": g.at(F.col("p"), i) for i, n in enumerate("xyz")}}
    joints = ps.joint_values(frames, keys, pose).select(*keys, F.concat(F.lit("pose_"), F.element_at(F.array(*map(F.lit, "xyz")), F.col("axis") + 1)).alias("feature"), F.col("value").cast("double").alias("value"))
    long = _unpivoted(each, keys, named, "feature").unionByName(joints)
    return st.describe(long, [*keys, "feature"], "value")


def _unpivoted(rows: DataFrame, keys: list[str], named: dict[str, Column], name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    extra = extra or {}
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, c in named.items()])
    return rows.select(*keys, *[c.alias(n) for n, c in extra.items()], F.explode(pairs).alias("_x")).select(*keys, *extra, F.col("_x.k").alias(name), F.col("_x.v").alias("value"))


def signal_relationships(points: DataFrame, geometry: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson and Spearman of the signal with point variables, and of frames' median signal with frame variables.

    points: keys, x, y, z, doppler, signal; geometry: as frame_geometry gives it.
    """
    of_point = {"range": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), "abs_doppler": F.abs("doppler"), "x": F.col("x"), "y": F.col("y"), "z": F.col("z")}
    long = _unpivoted(points, keys, of_point, "related_variable", {"signal": F.col("signal").cast("double"), "level": F.lit("point")})
    frames = _unpivoted(geometry, keys, {n: F.col(n) for n in FRAME_VARIABLES}, "related_variable", {"signal": F.col("return_signal_median"), "level": F.lit("frame")})
    every = written(long.unionByName(frames), "signal-pairs")  # counts, correlations and ranks read it
    group = [*keys, "level", "related_variable"]
    pearson = st.paired_corr(every, group, "signal", "value", "pearson").drop("n")
    spearman = st.spearman(every, group, "signal", "value").select(*group, "spearman")
    return every.groupBy(group).agg(F.count("*").alias("samples")).join(pearson, group, "left").join(spearman, group, "left")


def strength_groups(samples: DataFrame, keys: list[str], percentile: str, distance: str, near: float = 0.2) -> DataFrame:
    """Distances by strength: the lower quarter of the frame's percentiles, the middle and the upper quarter."""
    p = F.col(percentile)
    group = F.when(p <= 0.25, "bottom_25_percent").when(p >= 0.75, "top_25_percent").otherwise("middle_50_percent")
    rows = samples.where(p.isNotNull()).withColumn("strength_group", group)
    by = [*keys, "strength_group"]
    share = lambda limit: F.avg((F.col(distance) <= limit).cast("double"))
    base = rows.groupBy(by).agg(F.count("*").alias("points"), share(0.10).alias("fraction_within_10cm"), share(near).alias("fraction_within_20cm"), share(0.30).alias("fraction_within_30cm"))
    median = st.quantiles(st.distribution(rows, by, distance), by, (0.5,)).select(*by, F.col("value").alias("median_skeleton_distance_m"))
    return base.join(median, by)


def signal_candidates(samples: DataFrame, keys: list[str], frame_id: str, signal: str = "signal") -> DataFrame:
    """samples with the forms of the signal: raw, log1p, db10, window_robust and window_percentile (per frame)."""
    positive = samples.where(F.col(signal) > 0)
    low = st.quantiles(st.distribution(positive, keys, signal), keys, (0.01,)).select(*keys, F.greatest(F.col("value") * 0.1, F.lit(1e-6)).alias("_eps"))
    out = samples.join(F.broadcast(low), keys, "left") if keys else samples.join(F.broadcast(low), how="left")  # a row for each domain
    up = F.greatest(F.col(signal).cast("double"), F.lit(0.0))
    out = out.withColumns({"raw": F.col(signal).cast("double"), "log1p": F.log1p(up), "db10": F.log10(up + F.coalesce("_eps", F.lit(1e-6))) * 10.0}).drop("_eps")
    out = st.robust_scale(out, [*keys, frame_id], signal, 5.0, "window_robust")
    return st.percentile_ranks(out, [*keys, frame_id], signal, False, "window_percentile")


CANDIDATES = ("raw", "log1p", "db10", "window_robust", "window_percentile")


def normalisation_comparison(candidates: DataFrame, reference: str, identity: list[str], range_col: str, edges: list[float], seed: int = 0) -> DataFrame:
    """How well each form of the signal still tells the domains apart: over all points, and matched by range.

    candidates: as signal_candidates gives it, with a boolean column `reference`; identity names a point.
    """
    long = lambda df: _unpivoted(df, [], {n: F.col(n) for n in CANDIDATES}, "normalisation", {"side": F.col(reference), "other": ~F.col(reference)})
    candidates = written(candidates.select(*identity, range_col, reference, *CANDIDATES), "signal-forms")
    every = written(long(candidates), "signal-long")
    matched = written(long(matched_sample(st.in_bins(candidates, range_col, edges, "_bin"), ["_bin"], reference, identity, seed)), "signal-matched")
    key = ["normalisation"]
    apart = lambda df, ks, auc: st.ks_and_auc(df, key, "value", "side").select(*key, F.col("ks").alias(ks), F.greatest("auc", 1 - F.col("auc")).alias(auc))
    out = every.groupBy(key).agg(F.count_if("side").alias("reference_points"), F.count_if("other").alias("target_points"))
    parts = [
        st.gap_and_wasserstein(every, key, "value", "side"), apart(every, "ks_statistic", "domain_auc"),
        matched.groupBy(key).agg(F.count_if("side").alias("matched_points")), apart(matched, "matched_ks", "matched_domain_auc"),
    ]
    for part in parts:
        out = out.join(part, key, "left")
    return out.select(*key, "reference_points", "target_points", "quantile_gap", "ks_statistic", "wasserstein", "domain_auc", "matched_points", "matched_domain_auc", "matched_ks")


def model_feature_values(points: DataFrame, keys: list[str], window: str) -> tuple[DataFrame, DataFrame]:
    """The model's features of every point (long form: keys, feature, value), and keys, group, saturation.

    points: keys, window, x, y, z, doppler, signal. A window's centre and signal scale are
    medians over all its points; saturation is the share of values at their clip.
    """
    key = [*keys, window]
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    scale = points.groupBy(key).agg(*[F.get(q(c), F.lit(1)).alias(f"_m{c}") for c in "xyz"], q("signal").alias("_s"))
    rows = st.percentile_ranks(points, key, "signal", True, "_rank").join(scale, key)
    iqr = F.greatest(F.get("_s", F.lit(2)) - F.get("_s", F.lit(0)), F.lit(1e-3))
    raw = {f"absolute_{c}": F.col(c) / FEATURE_LIMITS["absolute"][0] for c in "xyz"} | {f"centred_{c}": (F.col(c) - F.col(f"_m{c}")) / FEATURE_LIMITS["centred"][0] for c in "xyz"}
    raw |= {"doppler": F.col("doppler") / FEATURE_LIMITS["doppler"][0], "signal_robust": (F.col("signal") - F.get("_s", F.lit(1))) / iqr, "signal_rank": F.col("_rank")}
    long = _unpivoted(rows, keys, raw, "feature")
    limit = F.when(F.col("feature") == "signal_robust", FEATURE_LIMITS["signal_robust"][1]).when(F.col("feature") != "signal_rank", 2.0)
    cut = F.when(limit.isNull(), F.col("value")).otherwise(F.greatest(-limit, F.least(limit, F.col("value"))))
    values = long.select(*keys, "feature", F.when(F.col("feature") == "signal_robust", cut / 5.0).otherwise(cut).alias("value"))
    group = F.when(F.col("feature").startswith("absolute"), "absolute_xyz").when(F.col("feature").startswith("centred"), "centred_xyz").otherwise(F.col("feature"))
    saturation = long.where("feature <> 'signal_rank'").withColumn("group", group).groupBy(*keys, "group").agg(F.avg((F.abs("value") >= limit).cast("double")).alias("saturation"))
    return values, saturation


def model_feature_tables(points: DataFrame, reference: str, window: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Descriptions and saturation of the features of both domains, and the gap of each feature that both have."""
    values, saturation = model_feature_values(points, [reference], window)
    values = written(values, "model-features")
    both = values.groupBy("feature").agg(F.countDistinct(reference).alias("n")).where("n = 2").select("feature")
    return st.describe(values, [reference, "feature"], "value"), st.quantile_gap(values.join(F.broadcast(both), "feature"), ["feature"], "value", reference), saturation


def windowed_features(points: Column, spatial: str = "legacy", signal: str = "none", anchor: Column | None = None, doppler_limit: float = 3.0) -> Column:
    """Model features of a sampled window, an array of points with relative time as the sixth number; padding gives zeros.

    spatial: legacy (centred on the valid points' medians) or cloud_anchor; signal: none,
    robust (median and IQR of the valid points, cut at 5) or rank (average ranks in [-1, 1]).
    """
    if signal not in ("none", "robust", "rank"):
        raise ValueError(f"unknown signal mode {signal!r}")
    if spatial == "cloud_anchor" and anchor is None:
        raise ValueError("cloud_anchor features need an anchor")
    valid = lambda p: (F.size(p) >= 5) & F.forall(F.slice(p, 1, 5), g.is_finite) & F.exists(F.slice(p, 1, 3), lambda x: F.abs(x) > 1e-8)
    kept = F.filter(points, valid)
    of = lambda i: F.transform(kept, lambda p: g.at(p, i).cast("double"))
    medians = F.array(*[F.coalesce(_median_of(of(i)), F.lit(0.0)) for i in range(3)])
    signals = F.array_sort(F.transform(kept, lambda p: g.at(p, 4).cast("double")))

    def quantile(s: Column, q: float) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low, high = F.get(s, F.floor(place).cast("int")), F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    def strength(p: Column, s: Column) -> list[Column]:
        x = g.at(p, 4).cast("double")
        if signal == "robust":
            z = (x - quantile(s, 0.5)) / F.greatest(quantile(s, 0.75) - quantile(s, 0.25), F.lit(1e-3))
            return [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)) / 5.0]
        if signal == "rank":
            below, same = F.size(F.filter(s, lambda v: v < x)), F.size(F.filter(s, lambda v: v == x))
            return [2.0 * (below + (same + 1) / 2.0) / F.size(s) - 1.0]
        return []

    def features(centre: Column) -> Column:
        def one(s: Column) -> Column:
            def row(p: Column) -> Column:
                base = g.normalised_features(p, centre, spatial, doppler_limit)
                n = 7 if spatial == "legacy" else 5
                full = F.concat(F.slice(base, 1, n), F.array(*strength(p, s)), F.slice(base, n + 1, 1)) if signal != "none" else base
                return F.when(valid(p), full).otherwise(F.transform(full, lambda _: F.lit(0.0)))

            return F.transform(points, row)

        return g.bound(signals, one)

    return g.bound(anchor if spatial == "cloud_anchor" else medians, features)


def bin_labels(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a bounded value: its share of the span, cut to 0..1, on bins labels, half to even."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.bround(part * (bins - 1)).cast("long")


def normalised_half(value: Column, low: Column, high: Column) -> Column:
    """Share of the span from low to high; a half where it has no length, null where value is not finite."""
    return F.when(g.is_finite(value), F.when(high > low, (value - low) / (high - low)).otherwise(0.5))


def frame_anchors(frames: DataFrame, points: str = "points") -> DataFrame:
    """frames that hold a valid point, with `anchor`, the geometric median of these; points are left out."""
    each = frames.withColumn("_valid", g.model_points(F.col(points))).where(F.size("_valid") > 0)
    return each.withColumn("anchor", ps.geometric_median("_valid")).drop("_valid", points)


def cloud_anchor(frames: DataFrame, keys: list[str], time: str = "relative_time", points: str = "points") -> DataFrame:
    """keys, anchor: geometric median of each frame's valid points, then a Theil-Sen line over the frames at time 0."""
    return lines_at_zero(frame_anchors(frames.select(*keys, time, points), points), keys, time)


def lines_at_zero(anchors: DataFrame, keys: list[str], time: str = "relative_time", anchor: str = "anchor") -> DataFrame:
    """keys, anchor: where the Theil-Sen lines through a window's frame anchors stand at time 0.

    A window is a few frames, so its pairs are made in the row that holds them.
    """
    rows = anchors.groupBy(keys).agg(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.slice(anchor, 1, 3).alias("p"))).alias("_x"))

    def line(axis: int) -> Column:
        own = F.filter(F.transform("_x", lambda x: F.struct(x["t"].alias("t"), g.at(x["p"], axis).alias("y"))), lambda x: g.is_finite(x["y"]))
        pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b["t"] - a["t"] > 1e-12), lambda b: (b["y"] - a["y"]) / (b["t"] - a["t"]))))
        slope = F.coalesce(_median_of(pairs), F.lit(0.0))
        return _median_of(F.transform(own, lambda x: x["y"] - slope * x["t"]))

    return rows.select(*keys, F.array(*[line(i) for i in range(3)]).alias("anchor"))


def frame_balanced_sample(windows: DataFrame, keys: list[str], frames: str, points: int, width: int) -> DataFrame:
    """keys, tokens (points with relative time), token_mask: each frame's quota of a window's tokens.

    frames: array of relative_time, points in order of time. Frames over their quota give
    far apart points, sparse ones are padded with masked zeros. A window without a valid
    point unmasks its first token.
    """
    quotas = frame_quotas(points, width)
    each = windows.select(*keys, F.posexplode(frames).alias("_at", "_f"))
    timed = F.transform(F.filter(F.coalesce(F.col("_f.points"), F.array().cast("array<array<double>>")), lambda p: F.size(g.model_points(F.array(p))) > 0), lambda p: F.concat(F.slice(p, 1, 5), F.array(F.col("_f.relative_time").cast("double"))))
    each = each.withColumns({"_p": g.canonical_order(timed), "_quota": F.element_at(F.array(*map(F.lit, quotas)), F.col("_at") + 1)}).where("_quota > 0")
    chosen = F.when(F.size("_p") <= F.col("_quota"), F.col("_p"))
    for quota in sorted({q for q in quotas if q}):
        chosen = chosen.when(F.col("_quota") == quota, ps.farthest_points(quota)(F.when((F.size("_p") > quota) & (F.col("_quota") == quota), F.col("_p"))))
    each = each.withColumn("_p", chosen)
    pad = F.col("_quota") - F.size("_p")
    each = each.withColumns({"_mask": F.concat(F.array_repeat(F.lit(True), F.size("_p")), F.array_repeat(F.lit(False), pad)), "_p": F.concat("_p", F.array_repeat(F.array_repeat(F.lit(0.0), 6), pad))})
    whole = each.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_p", "_mask"))).alias("_x"))
    mask = F.flatten(F.transform("_x", lambda x: x["_mask"]))
    seen = F.when(F.exists(mask, lambda m: m), mask).otherwise(F.transform(mask, lambda _, i: i == 0))
    return whole.select(*keys, F.flatten(F.transform("_x", lambda x: x["_p"])).alias("tokens"), seen.alias("token_mask"))


def kabsch_rotation(source: DataFrame, target: DataFrame, pose: str) -> tuple[np.ndarray, float, float]:
    """The proper row-vector rotation between the body joints' median templates, and the RMSE before and after.

    Medians in Spark; 45 numbers of each side and a 3 by 3 SVD on the driver.
    """
    return _template_rotation(*[ps.median_template(frames, [], pose).where(F.col("joint").isin(*g.BODY15)) for frames in (source, target)])


def _template_rotation(source: DataFrame, target: DataFrame) -> tuple[np.ndarray, float, float]:
    """kabsch_rotation of templates that are known."""

    def template(medians: DataFrame) -> np.ndarray:
        out = np.zeros((len(g.BODY15), 3))
        for r in medians.collect():
            out[g.BODY15.index(r["joint"]), r["axis"]] = r["value"]
        return out - out.mean(axis=0)

    a, b = template(source), template(target)
    u, _, vt = np.linalg.svd(a.T @ b)
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = u @ turn @ vt
    rmse = lambda d: float(np.sqrt((d * d).sum(axis=1).mean()))
    return rotation, rmse(a - b), rmse(a @ rotation - b)


#: The sets of numbers whose quantiles compare two domains; those of the target are taken along directions.
NUMBERS = ("reference_shape", "reference_root", "reference_pose", "reference_points", "reference_centred", "template", "shape", "root", "pose", "points", "centred")
_GROUP = ["numbers", "joint", "axis"]


def _flat_numbers(frames: DataFrame, frame_id: str, points: str, pose: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Joints (number, place p and shape r), points (place p) and points from the pelvis (r), a row each.

    p0 to p2 and r0 to r2 are the coordinates, p_whole and r_whole say whether all of them are finite.
    """
    one = frames.select(frame_id, F.col(pose).alias("_pose"), F.col(points).alias("_points"))
    joints = one.withColumn("_s", g.normalised_shape(F.col("_pose"))).select(F.posexplode(F.arrays_zip(F.col("_pose").alias("p"), F.col("_s").alias("r"))).alias("joint", "z")).select("joint", "z.p", "z.r")
    centred = root_centred_points(one, [], frame_id, "_points", "_pose").select(F.col("point").alias("r"))

    def flat(rows: DataFrame, own: list[str], names: str, label: str) -> DataFrame:
        scalars = [g.at(F.col(c), i).cast("double").alias(f"{c}{i}") for c in names for i in range(3)]
        return written(rows.select(*own, *scalars, *[F.forall(F.slice(c, 1, 3), g.is_finite).alias(f"{c}_whole") for c in names]), label)

    return flat(joints, ["joint"], "pr", "joint-numbers"), flat(one.select(F.explode("_points").alias("p")), [], "p", "point-numbers"), flat(centred, [], "r", "centred-numbers")


def _long_numbers(rows: DataFrame, wanted: list[tuple[str, Column | int, int, Column]]) -> DataFrame:
    """numbers, joint, axis, value in a long form of rows."""
    key = lambda c: F.lit(c).cast("tinyint")
    each = [F.struct(key(NUMBERS.index(n)).alias("numbers"), key(joint).alias("joint"), key(axis).alias("axis"), v.alias("value")) for n, joint, axis, v in wanted]
    return rows.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _reference_numbers(joints: DataFrame, cloud: DataFrame, centred: DataFrame) -> DataFrame:
    """Numbers of the reference domain on its own three axes; places count where they are whole."""
    joint = F.col("joint")
    whole = lambda name, c: [(name, 0, i, F.when(F.col(f"{c}_whole"), F.col(f"{c}{i}"))) for i in range(3)]
    each = lambda name, joint, c: [(name, joint, i, F.col(f"{c}{i}")) for i in range(3)]
    return reduce(DataFrame.unionByName, [
        _long_numbers(joints, whole("reference_pose", "p")), _long_numbers(joints.where(joint == 0), each("reference_root", 0, "p")), _long_numbers(joints.where(joint.isin(*g.BODY15)), each("reference_shape", joint, "r")),
        _long_numbers(cloud, whole("reference_points", "p")), _long_numbers(centred, whole("reference_centred", "r")),
    ])


def _numbers_along(joints: DataFrame, cloud: DataFrame, centred: DataFrame, directions: dict[int, tuple[float, ...]], template: bool = False) -> DataFrame:
    """Numbers of the target domain along directions, whose keys stand for the axis; what is not whole is finite along none.

    template: the shapes on their own axes too, each coordinate by itself.
    """
    joint = F.col("joint")
    along = lambda c, d: sum((F.col(f"{c}{j}") * x for j, x in enumerate(d)), F.lit(0.0))
    every = lambda name, joint, c: [(name, joint, k, along(c, d)) for k, d in directions.items()]
    own = [("template", joint, i, F.col(f"r{i}")) for i in range(3)] if template else []
    return reduce(DataFrame.unionByName, [
        _long_numbers(joints, every("pose", 0, "p")), _long_numbers(joints.where(joint == 0), every("root", 0, "p")), _long_numbers(joints.where(joint.isin(*g.BODY15)), every("shape", joint, "r") + own),
        _long_numbers(cloud, every("points", 0, "p")), _long_numbers(centred, every("centred", 0, "r")),
    ])


def _number_quantiles(numbers: DataFrame) -> DataFrame:
    """The quantiles that each set of numbers is compared by."""
    is_any = lambda *names: F.col("numbers").isin(*[NUMBERS.index(n) for n in names])
    lits = lambda qs: F.array(*map(F.lit, qs))
    qs = F.when(is_any("template", "reference_root", "root"), lits((0.5,))).when(is_any("reference_shape", "shape"), lits((0.25, 0.5, 0.75))).otherwise(lits(st.GAP))
    return written(st.group_quantiles(numbers, _GROUP, "value", qs), "number-quantiles")  # some hundred groups


def reference_frame_hypotheses(reference: DataFrame, target: DataFrame, frame_id: str, points: str, pose: str, pitch_down_deg: float = g.SENSOR_PITCH_DOWN_DEG, height: float = g.SENSOR_HEIGHT_M) -> DataFrame:
    """Five rigid placements of the target domain, scored against the reference domain and ranked.

    As it is, by the sensor's mounting (with and without its height), and by the rotation
    between the pose templates (with and without the medians' translation). Equal scores rank by name.

    A moved coordinate is a coordinate along a row of the rotation, plus a translation. So quantiles are taken
    once along each of the eight directions that the rotations have; a translation shifts
    them and leaves shapes and root-centred points alone, and rotated covariances are those as they are, rotated.
    """
    spark = reference.sparkSession
    level = np.array(g.sensor_rotation(pitch_down_deg)).T
    ref, own = (_flat_numbers(df, frame_id, points, pose) for df in (reference, target))
    directions: list[tuple[float, ...]] = []  # eight at most

    def added(*rotations: np.ndarray) -> dict[int, tuple[float, ...]]:
        """Directions of the rotations that are not known yet."""
        start = len(directions)
        for row in (tuple(map(float, row)) for r in rotations for row in r.T):
            if row not in directions:
                directions.append(row)
        return dict(list(enumerate(directions))[start:])

    cuts = _number_quantiles(_reference_numbers(*ref).unionByName(_numbers_along(*own, added(np.eye(3), level), template=True)))
    of = lambda name: cuts.where(F.col("numbers") == NUMBERS.index(name)).drop("numbers")
    turn, _, _ = _template_rotation(of("template"), of("reference_shape").where("q = 0.5"))
    new = added(turn)
    if new:
        cuts = cuts.unionByName(_number_quantiles(_numbers_along(*own, new)))
    medians = lambda name: {r["axis"]: r["value"] for r in of(name).collect()}
    here, there = medians("reference_root"), medians("root")
    shift = np.array([here.get(i, 0.0) - there.get(directions.index(tuple(map(float, row))), 0.0) for i, row in enumerate(turn.T)])
    tried = [
        ("sensor_as_recorded", 0, np.zeros(3)), ("mounting_rotation_only", 1, np.zeros(3)), ("mounting_rotation_and_height", 1, np.array([0.0, 0.0, height])),
        ("pose_template_rotation_only", 2, np.zeros(3)), ("pose_template_rotation_and_translation", 2, shift),
    ]
    rotations = [np.eye(3), level, turn]
    rows = [(n, k, t.tolist(), *map(float, g.euler_angles(rotations[k].tolist()))) for n, k, t in tried]
    table = spark.createDataFrame(rows, "hypothesis string, turned int, translation array<double>, euler_x_deg double, euler_y_deg double, euler_z_deg double")
    axes = [(k, i, directions.index(tuple(map(float, row)))) for k, r in enumerate(rotations) for i, row in enumerate(r.T)]
    axes = F.broadcast(spark.createDataFrame(axes, "turned int, axis int, direction int"))  # nine rows
    key, same = ["hypothesis"], ["turned"]

    def placed(name: str) -> DataFrame:
        return of(name).withColumnRenamed("axis", "direction").join(axes, "direction")

    def spread(rows: DataFrame, own: list[str]) -> DataFrame:
        pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
        return rows.groupBy(*own, "joint", "axis").agg(pick(0.5).alias("m"), F.greatest(pick(0.75) - pick(0.25), F.lit(1e-6)).alias("iqr"))

    def gaps(name: str) -> DataFrame:
        moved = placed(name).join(F.broadcast(table), same).withColumn("value", F.col("value") + F.get("translation", F.col("axis")))  # five rows
        return ps._quantile_gaps(of(f"reference_{name}"), moved, key)

    # these are computed once for each rotation, so hypotheses that share one have equal scores
    pose_part = ps._shape_gaps(spread(of("reference_shape"), []), spread(placed("shape"), same), same)
    pose_part = pose_part.select(*same, F.col("score").alias("pose_score"), F.col("median_gap").alias("pose_median_gap"), F.col("iqr_gap").alias("pose_iqr_gap"))
    # a point without one of three coordinates has no place once it is moved
    point = F.array(*[F.col(f"r{i}") for i in range(3)])
    as_is = ps._covariances(own[2].where(F.forall(point, lambda x: x.isNotNull())).select(point.alias("point")), [], "point")
    at = lambda r, i, j: sum((F.col("cov")[3 * a + b] * float(r[a, i] * r[b, j]) for a in range(3) for b in range(3)), F.lit(0.0))
    turned = [F.struct(F.lit(k).alias("turned"), F.array(*[at(r, i, j) for i in range(3) for j in range(3)]).alias("cov")) for k, r in enumerate(rotations)]
    covariances = as_is.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    quantile_gaps = ps._quantile_gaps(of("reference_centred"), placed("centred"), same)
    centred = ps._point_gaps(ps._covariances(ref[2].select(point.alias("point")), [], "point"), covariances, quantile_gaps, same)
    centred = centred.select(*same, F.col("score").alias("point_score"), F.col("covariance_gap").alias("point_covariance_gap"))
    pose_gap, point_gap = gaps("pose").withColumnRenamed("xyz_gap", "pose_xyz_gap"), gaps("points").withColumnRenamed("xyz_gap", "point_xyz_gap")
    out = table.join(pose_part, same).join(centred, same).join(pose_gap, key).join(point_gap, key).drop(*same)
    return ps.ranked(out.withColumn("composite_score", F.col("pose_score") + F.col("point_score")), "composite_score", "hypothesis")
