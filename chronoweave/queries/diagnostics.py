"""Window loaders and domain diagnostics over the driver's tables.

Embeddings are bodies: 17 joints and a cloud of ten points; vectors of an even label are
the reference domain. Events are frames: views are radar frames, purchases poses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators import diagnostics as dg
from chronoweave.operators import statistics as st
from chronoweave.plans import context, windows
from chronoweave.queries.data import SAMPLES, of_type, samples
from chronoweave.queries.frames import _E, _JOINTS, _LIMB_ROWS, _PTS, _bodies

EDGES = [0.0, 0.1, 0.2, 0.3, 0.5]
WIDTH = 3


def _domains(spark, sf_dir):
    return _bodies(spark, sf_dir).withColumn("reference", F.col("label") % 2 == 0)


def _rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


def _points(spark, sf_dir):
    each = _domains(spark, sf_dir).select("reference", "vec_id", "pose", F.posexplode("points").alias("pos", "p"))
    names = ("x", "y", "z", "doppler", "signal")
    return each.select("reference", "vec_id", "pos", "pose", "p", *[g.at(F.col("p"), i).alias(n) for i, n in enumerate(names)])


def frame_geometry(spark, sf_dir):
    return _rounded(dg.frame_geometry(_domains(spark, sf_dir), ["reference"], "vec_id", "points", "pose"), "reference", "vec_id", "point_count")


def offset_summary(spark, sf_dir):
    out = dg.offset_summary(dg.frame_geometry(_domains(spark, sf_dir), ["reference"], "vec_id", "points", "pose"), ["reference"])
    return _rounded(out, "reference", "axis", "frames")


def signal_relationships(spark, sf_dir):
    geometry = dg.frame_geometry(_domains(spark, sf_dir), ["reference"], "vec_id", "points", "pose")
    return _rounded(dg.signal_relationships(_points(spark, sf_dir), geometry, ["reference"]), "reference", "level", "related_variable", "samples")


def strength_groups(spark, sf_dir):
    from chronoweave.operators.pose import skeleton_distances

    rows = st.percentile_ranks(_points(spark, sf_dir), ["reference", "vec_id"], "signal")
    near = skeleton_distances(rows, ["reference", "vec_id", "pos", "percentile"], "p", "pose")
    return _rounded(dg.strength_groups(near, ["reference"], "percentile", "d"), "reference", "strength_group", "points")


def normalisation_comparison(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).drop("pose", "p")
    out = dg.normalisation_comparison(dg.signal_candidates(rows, ["reference"], "vec_id"), "reference", ["vec_id", "pos"], "range", EDGES)
    # which points are matched is a draw of ours: their number is compared
    return _rounded(out.drop("matched_domain_auc", "matched_ks"), "normalisation", "reference_points", "target_points", "matched_points", digits=5)


def model_feature_statistics(spark, sf_dir):
    stats, _, _ = dg.model_feature_tables(_points(spark, sf_dir), "reference", "vec_id")
    return _rounded(stats.select("reference", "feature", "count", "min", "mean", "std", "max", "p5", "p50", "p95"), "reference", "feature", "count")


def model_feature_gaps(spark, sf_dir):
    return _rounded(dg.model_feature_tables(_points(spark, sf_dir), "reference", "vec_id")[1], "feature")


def model_feature_saturation(spark, sf_dir):
    return _rounded(dg.model_feature_tables(_points(spark, sf_dir), "reference", "vec_id")[2], "reference", "group")


def feature_statistics(spark, sf_dir):
    out = dg.feature_statistics(_domains(spark, sf_dir), ["reference"], "points", "pose")
    return _rounded(out.select("reference", "feature", "count", "mean", "std", "p50"), "reference", "feature", "count")


def reference_frame_hypotheses(spark, sf_dir):
    rows = _domains(spark, sf_dir)
    return dg.reference_frame_hypotheses(rows.where("reference"), rows.where("not reference"), "vec_id", "points", "pose")


def frame_balanced_sample(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    cut = lambda a, n, t: F.struct(F.lit(t).alias("relative_time"), F.slice("points", a, n).alias("points"))
    return dg.frame_balanced_sample(rows.select("vec_id", F.array(cut(1, 5, -1.0), cut(6, 4, 0.0), cut(10, 1, 1.0)).alias("frames")), ["vec_id"], "frames", 10, 3)


def bin_labels(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("vec_id", g.at(g.at(F.col("pose"), 0), 0).alias("x"))
    return rows.select("vec_id", dg.bin_labels(F.col("x"), F.lit(-0.25), F.lit(0.25), 64).alias("label"), F.round(dg.normalised_half(F.col("x"), F.lit(-0.25), F.lit(0.25)), 6).alias("share"))


def run_limits(spark, sf_dir):
    rows = samples(spark, sf_dir).select(F.col("user_id").cast("string").alias("subject_id"), F.lit("r").alias("run_id"), F.col("event_type").alias("device_type"), "sample_index", "event_id")
    runs = rows.groupBy("subject_id", "run_id", "device_type").agg((F.min("event_id") % 4 - 1).cast("string").alias("nominal_fps"))
    return context.run_limits(runs, rows, camera="view")


def available_roles(spark, sf_dir):
    rows = samples(spark, sf_dir).select(F.col("user_id").cast("string").alias("subject_id"), F.lit("r").alias("run_id"), F.lit("d").alias("device_type"), "sample_index", F.col("event_type").alias("artifact_role"))
    return context.available_roles(rows).select("subject_id", "sample_index", F.concat_ws(",", "roles").alias("roles"))


def _recordings(spark, sf_dir):
    """Mapping rows of clicks, radar frames of views (0 to 2 points), poses of purchases (some not finite), and rates."""
    rows = samples(spark, sf_dir).withColumn("subject_id", F.col("user_id").cast("string"))
    run = {"run_id": F.lit("r"), "device_type": F.lit("d")}
    click, view, buy = (of_type(rows, k).withColumns(run) for k in ("click", "view", "purchase"))
    mapping = click.select("subject_id", F.lit("v").alias("mapping_version_id"), *[F.lit(x).alias(f"{s}_{n}") for s in ("source", "target") for n, x in (("run_id", "r"), ("device_type", "d"))], F.col("sample_index").alias("source_sample_index"), F.col("sample_index").alias("target_sample_index"))
    point = F.array(F.col("value"), F.col("value") / 2, F.lit(1.0), F.lit(0.5), F.col("value"))
    radar = view.select("subject_id", "run_id", "device_type", "sample_index", F.array_repeat(point, (F.col("event_id") % 3).cast("int")).alias("points"))
    number = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    poses = buy.select("subject_id", "run_id", "device_type", "sample_index", F.array(F.array_repeat(F.array(number, number, number, F.lit(1.0)), 32)).alias("pose3d"))
    fps = mapping.select("subject_id", F.lit("r").alias("run_id"), F.lit("d").alias("device_type")).distinct().withColumn("target_fps", F.lit(20.0))
    return mapping, radar, poses, fps


_WINDOW = ("subject_id", "target_sample_index", "n_frames", "centre_points", "window_points", "valid_frames", "status")


def _columns(df, *more):
    return df.select("subject_id", "target_sample_index", "target_window_start", "target_window_end", "n_frames", *[F.col(c).cast("long").alias(c) for c in ("centre_points", "window_points", "valid_frames")], "status", *more)


def supervised_windows(spark, sf_dir):
    mapping, radar, poses, fps = _recordings(spark, sf_dir)
    return _columns(windows.supervised_windows(mapping, radar, poses, WIDTH, fps, least_window=2, least_frames=2))


def inference_windows(spark, sf_dir):
    mapping, radar, poses, fps = _recordings(spark, sf_dir)
    return _columns(windows.inference_windows(mapping, radar, poses, WIDTH, fps, least_window=2, least_frames=2), "ground_truth_available", "ground_truth_issue")


def diagnostic_windows(spark, sf_dir):
    mapping, radar, poses, _ = _recordings(spark, sf_dir)
    return _columns(windows.diagnostic_windows(mapping, radar, poses, WIDTH))


def window_anchors(spark, sf_dir):
    mapping, radar, poses, fps = _recordings(spark, sf_dir)
    usable = windows.supervised_windows(mapping, radar, poses, WIDTH, fps, least_window=2, least_frames=2)
    return windows.window_anchors(usable, radar).select("subject_id", "target_sample_index", "anchor", F.size(windows.stacked_points()).alias("stacked"))


_DOMAIN = "f AS (SELECT vec_id, label % 2 = 0 AS reference, v FROM e)"
_CLOUD = f"{_E}, {_PTS}, {_DOMAIN}, q AS (SELECT f.reference, pts.vec_id, pts.pos, pts.x, pts.y, pts.z, pts.d AS doppler, pts.v[6*pts.pos+5] AS signal, pts.v FROM pts JOIN f USING (vec_id))"
_SKELETON = f"""
limbs AS (SELECT * FROM (VALUES {_LIMB_ROWS}) t(a, b)),
sk AS (SELECT q.reference, q.vec_id, q.pos, q.x - v[3*a+1] AS px, q.y - v[3*a+2] AS py, q.z - v[3*a+3] AS pz, v[3*b+1] - v[3*a+1] AS bx, v[3*b+2] - v[3*a+2] AS dy, v[3*b+3] - v[3*a+3] AS bz FROM q, limbs),
st AS (SELECT *, CASE WHEN bx*bx + dy*dy + bz*bz < 1e-12 THEN 0 ELSE greatest(0.0, least(1.0, (px*bx + py*dy + pz*bz) / (bx*bx + dy*dy + bz*bz))) END AS t FROM sk),
near AS (SELECT reference, vec_id, pos, min(sqrt(pow(px - t*bx, 2) + pow(py - t*dy, 2) + pow(pz - t*bz, 2))) AS d FROM st GROUP BY ALL)"""
_BONES = ", ".join(f"sqrt(pow(v[{3*a+1}]-v[{3*b+1}],2)+pow(v[{3*a+2}]-v[{3*b+2}],2)+pow(v[{3*a+3}]-v[{3*b+3}],2))" for a, b in g.LIMBS)
_GEOMETRY = f"""{_CLOUD}, {_SKELETON},
c AS (SELECT reference, vec_id, count(*) AS point_count, quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, quantile_cont(z, 0.5) AS cz, quantile_cont(signal, 0.5) AS signal, quantile_cont(abs(doppler), 0.5) AS doppler, quantile_cont(sqrt(x*x + y*y + z*z), 0.5) AS rng FROM q GROUP BY ALL),
s AS (SELECT vec_id, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50 FROM near GROUP BY vec_id),
b AS (SELECT vec_id, list_aggregate([{_BONES}], 'median') AS bone, sqrt(pow(v[25]-v[1],2)+pow(v[26]-v[2],2)+pow(v[27]-v[3],2)) AS neck, v FROM e),
geo AS (SELECT c.reference, c.vec_id, c.point_count, cx, cy, cz, v[1] AS px, v[2] AS py, v[3] AS pz, cx - v[1] AS ox, cy - v[2] AS oy, cz - v[3] AS oz, s.p25, s.p50, neck, bone, signal, doppler, rng FROM c JOIN s USING (vec_id) JOIN b USING (vec_id))"""
_RANKED = "r AS (SELECT *, (rank() OVER (PARTITION BY vec_id ORDER BY signal) + (count(*) OVER (PARTITION BY vec_id, signal) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY vec_id) AS pct FROM q)"
_RHO = "(rank() OVER (PARTITION BY reference, level, related_variable ORDER BY {c}) + (count(*) OVER (PARTITION BY reference, level, related_variable, {c}) - 1) / 2.0::DOUBLE)"
_MODEL = f"""{_CLOUD}, {_RANKED},
m AS (SELECT vec_id, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz, quantile_cont(signal, 0.25) AS q1, quantile_cont(signal, 0.5) AS q2, quantile_cont(signal, 0.75) AS q3 FROM q GROUP BY vec_id),
raw AS (
  SELECT reference, unnest(['absolute_x', 'absolute_y', 'absolute_z', 'centred_x', 'centred_y', 'centred_z', 'doppler', 'signal_robust', 'signal_rank']) AS feature,
         unnest([x / 4.0::DOUBLE, y / 4.0::DOUBLE, z / 4.0::DOUBLE, (x - mx) / 2.0::DOUBLE, (y - my) / 2.0::DOUBLE, (z - mz) / 2.0::DOUBLE, doppler / 3.0::DOUBLE, (signal - q2) / greatest(q3 - q1, 1e-3::DOUBLE), 2 * pct - 1]) AS value
  FROM r JOIN m USING (vec_id)
),
val AS (SELECT reference, feature, CASE WHEN feature = 'signal_rank' THEN value WHEN feature = 'signal_robust' THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, value)) / 5 ELSE greatest(-2.0::DOUBLE, least(2.0::DOUBLE, value)) END AS value FROM raw)"""
_CANDIDATES = f"""{_CLOUD}, {_RANKED},
eps AS (SELECT reference, greatest(quantile_cont(signal, 0.01) * 0.1::DOUBLE, 1e-6::DOUBLE) AS eps FROM q WHERE signal > 0 GROUP BY reference),
w AS (SELECT vec_id, quantile_cont(signal, 0.25) AS q1, quantile_cont(signal, 0.5) AS q2, quantile_cont(signal, 0.75) AS q3 FROM q GROUP BY vec_id),
l AS (
  SELECT reference, unnest(['raw', 'log1p', 'db10', 'window_robust', 'window_percentile']) AS normalisation,
         unnest([signal, ln(1 + greatest(signal, 0.0::DOUBLE)), log10(greatest(signal, 0.0::DOUBLE) + eps) * 10, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (signal - q2) / greatest(q3 - q1, 1e-6::DOUBLE))) / 5, pct]) AS value
  FROM r JOIN w USING (vec_id) JOIN eps USING (reference)
)"""
_GAP = "[0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]"


def _gap_sql(table: str, key: str) -> str:
    return f"""g0 AS (SELECT {key}, quantile_cont(value, {_GAP}) FILTER (WHERE reference) AS a, quantile_cont(value, {_GAP}) FILTER (WHERE NOT reference) AS b FROM {table} GROUP BY {key}),
gap AS (SELECT {key}, list_avg(list_transform(range(1, 8), lambda i: abs(b[i] - a[i]))) / greatest(a[5] - a[3], 0.05::DOUBLE) AS quantile_gap FROM g0)"""


_FRAMES = f"""
WITH {SAMPLES}, c AS (SELECT user_id, sample_index AS k, unnest([-1, 0, 1]) AS o FROM samples WHERE event_type = 'click'),
m AS (
  SELECT c.user_id, c.k, count(v.event_id) AS n, coalesce(max(CASE WHEN o = 0 THEN v.event_id % 3 END), 0) AS centre, coalesce(sum(v.event_id % 3), 0) AS pts, count(*) FILTER (WHERE v.event_id % 3 > 0) AS valid
  FROM c LEFT JOIN samples v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.sample_index = c.k + {{stride}} * c.o GROUP BY ALL
),
p AS (SELECT user_id, sample_index AS k, event_id % 5 <> 0 AS fine FROM samples WHERE event_type = 'purchase'),
z AS (SELECT m.*, p.fine FROM m LEFT JOIN p USING (user_id, k))
SELECT CAST(user_id AS VARCHAR) AS subject_id, k AS target_sample_index, k - {{stride}} AS target_window_start, k + {{stride}} AS target_window_end, n AS n_frames, CAST(centre AS BIGINT) AS centre_points, CAST(pts AS BIGINT) AS window_points, valid AS valid_frames, {{status}}
FROM z"""
_FEW = "WHEN n < 3 THEN 'incomplete_radar_window'"
_POINTS_SHORT = f"{_FEW} WHEN centre < 1 THEN 'too_few_center_points' WHEN pts < 2 THEN 'too_few_window_points' WHEN valid < 2 THEN 'too_few_valid_window_frames'"
_POSE = "WHEN fine IS NULL THEN 'missing_pose_payload' WHEN NOT fine THEN 'invalid_pose'"

SQL = {
    "frame_geometry": f"""
WITH {_GEOMETRY}
SELECT reference, vec_id, point_count, round(cx, 6) AS cloud_centroid_x_m, round(cy, 6) AS cloud_centroid_y_m, round(cz, 6) AS cloud_centroid_z_m, round(px, 6) AS pelvis_x_m, round(py, 6) AS pelvis_y_m, round(pz, 6) AS pelvis_z_m,
       round(ox, 6) AS centroid_minus_pelvis_x_m, round(oy, 6) AS centroid_minus_pelvis_y_m, round(oz, 6) AS centroid_minus_pelvis_z_m, round(p25, 6) AS point_to_skeleton_p25_m, round(p50, 6) AS point_to_skeleton_p50_m,
       round(neck, 6) AS pelvis_to_neck_m, round(bone, 6) AS median_bone_length_m, round(signal, 6) AS return_signal_median, round(doppler, 6) AS doppler_abs_median_mps, round(rng, 6) AS range_median_m FROM geo""",
    "offset_summary": f"""
WITH {_GEOMETRY}, o AS (SELECT reference, unnest([0, 1, 2]) AS axis, unnest([ox, oy, oz]) AS v FROM geo)
SELECT reference, CAST(axis AS INTEGER) AS axis, round(quantile_cont(v, 0.5), 6) AS median_m, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr_m, count(*) AS frames FROM o GROUP BY reference, axis""",
    "signal_relationships": f"""
WITH {_GEOMETRY}, a AS (
  SELECT reference, 'point' AS level, unnest(['range', 'abs_doppler', 'x', 'y', 'z']) AS related_variable, unnest([sqrt(x*x + y*y + z*z), abs(doppler), x, y, z]) AS value, signal FROM q
  UNION ALL SELECT reference, 'frame', unnest(['point_count', 'range_median_m', 'doppler_abs_median_mps']), unnest([CAST(point_count AS DOUBLE), rng, doppler]), signal FROM geo),
k AS (SELECT *, {_RHO.format(c="value")} AS rv, {_RHO.format(c="signal")} AS rs FROM a)
SELECT reference, level, related_variable, count(*) AS samples, round(CASE WHEN stddev_pop(value) >= 1e-12 THEN corr(signal, value) END, 6) AS pearson, round(CASE WHEN stddev_pop(rv) >= 1e-12 THEN corr(rs, rv) END, 6) AS spearman FROM k GROUP BY ALL""",
    "strength_groups": f"""
WITH {_CLOUD}, {_RANKED}, {_SKELETON},
z AS (SELECT r.reference, CASE WHEN pct <= 0.25 THEN 'bottom_25_percent' WHEN pct >= 0.75 THEN 'top_25_percent' ELSE 'middle_50_percent' END AS strength_group, d FROM r JOIN near USING (vec_id, pos))
SELECT reference, strength_group, count(*) AS points, round(quantile_cont(d, 0.5), 6) AS median_skeleton_distance_m, round(avg(CAST(d <= 0.1::DOUBLE AS INT)), 6) AS fraction_within_10cm, round(avg(CAST(d <= 0.2::DOUBLE AS INT)), 6) AS fraction_within_20cm, round(avg(CAST(d <= 0.3::DOUBLE AS INT)), 6) AS fraction_within_30cm
FROM z GROUP BY ALL""",
    "normalisation_comparison": f"""
WITH {_CANDIDATES}, {_gap_sql("l", "normalisation")},
n AS (SELECT normalisation, count(*) FILTER (WHERE reference) AS na, count(*) FILTER (WHERE NOT reference) AS nb FROM l GROUP BY normalisation),
d AS (SELECT normalisation, value, count(*) FILTER (WHERE reference) AS a, count(*) FILTER (WHERE NOT reference) AS b FROM l GROUP BY ALL),
u AS (SELECT *, sum(a) OVER w AS ua, sum(b) OVER w AS ub, a + b AS c, sum(a + b) OVER w AS uc FROM d WINDOW w AS (PARTITION BY normalisation ORDER BY value)),
t AS (SELECT normalisation, max(abs(ua / na::DOUBLE - ub / nb::DOUBLE)) AS ks, (sum(b * (uc - c + (c + 1) / 2.0::DOUBLE)) - any_value(nb) * (any_value(nb) + 1) / 2.0::DOUBLE) / (any_value(na) * any_value(nb))::DOUBLE AS auc FROM u JOIN n USING (normalisation) GROUP BY normalisation),
s AS (SELECT normalisation, quantile_cont(value, list_transform(range(0, 2001), lambda i: i / 2000.0::DOUBLE)) FILTER (WHERE reference) AS a, quantile_cont(value, list_transform(range(0, 2001), lambda i: i / 2000.0::DOUBLE)) FILTER (WHERE NOT reference) AS b FROM l GROUP BY normalisation),
h AS (SELECT sum(least(x, y)) AS matched FROM (SELECT floor(bin) AS bin, count(*) FILTER (WHERE reference) AS x, count(*) FILTER (WHERE NOT reference) AS y FROM (
  SELECT reference, CASE WHEN r < 0.1::DOUBLE THEN 0 WHEN r < 0.2::DOUBLE THEN 1 WHEN r < 0.3::DOUBLE THEN 2 WHEN r < 0.5::DOUBLE THEN 3 END AS bin FROM (SELECT reference, sqrt(x*x + y*y + z*z) AS r FROM q)) WHERE bin IS NOT NULL GROUP BY 1))
SELECT n.normalisation, na AS reference_points, nb AS target_points, round(quantile_gap, 5) AS quantile_gap, round(ks, 5) AS ks_statistic, round(list_avg(list_transform(range(1, 2002), lambda i: abs(s.a[i] - s.b[i]))), 5) AS wasserstein,
       round(greatest(auc, 1 - auc), 5) AS domain_auc, CAST((SELECT matched FROM h) AS BIGINT) AS matched_points
FROM n JOIN gap USING (normalisation) JOIN t USING (normalisation) JOIN s USING (normalisation)""",
    "model_feature_statistics": f"""
WITH {_MODEL}
SELECT reference, feature, count(*) AS count, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM val GROUP BY ALL""",
    "model_feature_gaps": f"WITH {_MODEL}, {_gap_sql('val', 'feature')} SELECT feature, round(quantile_gap, 6) AS quantile_gap FROM gap",
    "model_feature_saturation": f"""
WITH {_MODEL}
SELECT reference, CASE WHEN feature LIKE 'absolute%' THEN 'absolute_xyz' WHEN feature LIKE 'centred%' THEN 'centred_xyz' ELSE feature END AS "group", round(avg(CAST(abs(value) >= CASE WHEN feature = 'signal_robust' THEN 5 ELSE 2 END AS INT)), 6) AS saturation
FROM raw WHERE feature <> 'signal_rank' GROUP BY ALL""",
    "feature_statistics": f"""
WITH {_CLOUD}, {_JOINTS}, l AS (
  SELECT reference, unnest(['range', 'doppler', 'signal', 'point_x', 'point_y', 'point_z']) AS feature, unnest([sqrt(x*x + y*y + z*z), doppler, signal, x, y, z]) AS value FROM q
  UNION ALL SELECT label % 2 = 0, unnest(['pose_x', 'pose_y', 'pose_z']), unnest([x, y, z]) FROM j)
SELECT reference, feature, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50 FROM l GROUP BY ALL""",
    "bin_labels": "SELECT vec_id, CAST(round_even(greatest(0, least(1, (x + 0.25::DOUBLE) / 0.5::DOUBLE)) * 63, 0) AS BIGINT) AS label, round((x + 0.25::DOUBLE) / 0.5::DOUBLE, 6) AS share FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)",
    "run_limits": f"""
WITH {SAMPLES}, f AS (SELECT user_id, event_type, min(event_id) % 4 - 1 AS f, max(sample_index) AS m FROM samples GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS subject_id, 'r' AS run_id, event_type AS device_type, CAST(coalesce(m, 0) AS BIGINT) AS max_sample, CASE WHEN f > 0 THEN CAST(f AS DOUBLE) WHEN event_type = 'view' THEN 15.0::DOUBLE ELSE 20.0::DOUBLE END AS nominal_fps FROM f""",
    "available_roles": f"WITH {SAMPLES} SELECT CAST(user_id AS VARCHAR) AS subject_id, sample_index, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles FROM samples GROUP BY ALL",
    "supervised_windows": _FRAMES.format(stride=2, status=f"CASE {_POINTS_SHORT} {_POSE} ELSE 'ok' END AS status"),
    "inference_windows": _FRAMES.format(stride=2, status=f"CASE {_POINTS_SHORT} ELSE 'ok' END AS status, coalesce(fine, FALSE) AS ground_truth_available, CASE {_POSE} END AS ground_truth_issue"),
    "diagnostic_windows": _FRAMES.format(stride=1, status=f"CASE {_FEW} WHEN valid < 3 THEN 'empty_radar_frame' {_POSE} ELSE 'ok' END AS status"),
}

QUERIES = {f.__name__: f for f in (
    frame_geometry, offset_summary, signal_relationships, strength_groups, normalisation_comparison, model_feature_statistics, model_feature_gaps, model_feature_saturation, feature_statistics, reference_frame_hypotheses,
    frame_balanced_sample, bin_labels, run_limits, available_roles, supervised_windows, inference_windows, diagnostic_windows, window_anchors,
)}
