"""Frame windows, segments, splits, payloads and geometry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import geometry as g
from chronoweave.operators import frames as fr
from chronoweave.operators import pose
from chronoweave.queries.data import RUN, SAMPLES, of_type, samples, table


def index_window(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("points", F.array("event_id"))
    out = fr.index_window(rows, RUN, 2, "points")
    return out.select(*RUN, "sample_index", F.concat_ws(",", F.transform("window", lambda x: x.cast("string"))).alias("ids"))


def index_range(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("points", F.array("event_id", "sample_index"))
    out = fr.index_range(rows, 2, 4, "points", RUN)
    return out.select(*RUN, F.concat_ws(",", F.transform("points", lambda x: x.cast("string"))).alias("ids"))


def strided_windows(spark, sf_dir):
    rows = samples(spark, sf_dir)
    frames = of_type(rows, "view").withColumn("points", F.array(F.array("value")))
    centres = of_type(rows, "click").select("user_id", F.col("sample_index").alias("target_sample_index"), F.lit(2).alias("stride"))
    w = fr.window_support(fr.strided_windows(centres, frames, ["user_id"], 3, "points"), lambda p: F.size(p))
    w = fr.window_status(w, 3)
    return w.select("user_id", "target_sample_index", "n_frames", F.col("window_points").cast("long").alias("window_points"), "status")


def change_segments(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("high", F.col("value") > 50).select(*RUN, "sample_index", "high")
    return fr.change_segments(rows, RUN, "sample_index", "high")


def valid_centres(spark, sf_dir):
    return fr.valid_centres(change_segments(spark, sf_dir), RUN, 3).select(*RUN, "centre")


def sliding_support(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("flag", F.col("value") > 50)
    return fr.sliding_support(rows, RUN, "sample_index", "flag", 5).select(*RUN, "sample_index", "support")


def temporal_split(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"start": F.col("sample_index") - 1, "end": F.col("sample_index") + 1})
    return fr.temporal_split(rows, RUN, ["sample_index"], 0.2, "start", "end").select(*RUN, "sample_index", "part")


def calibration_split(spark, sf_dir):
    return fr.calibration_split(samples(spark, sf_dir), ["user_id"], ["t", "event_id"], 0.3).select("event_id", "part")


def lag_sweep(spark, sf_dir):
    rows = of_type(samples(spark, sf_dir), "click").select("user_id", "sample_index", "value")
    sweep = fr.lag_sweep(rows.withColumn("run", F.lit(0)), ["user_id"], "sample_index", lambda a, b: F.abs(a - b), "value", "value", 2)
    return sweep.select("user_id", "shift", F.round("error_mm", 3).alias("error_mm"), "frames")


def even_subsample(spark, sf_dir):
    return fr.even_subsample(samples(spark, sf_dir), ["event_type"], ["event_id"], 101).select("event_id", "event_type")


def stratified_cap(spark, sf_dir):
    kept = fr.stratified_cap(samples(spark, sf_dir), ["event_type"], ["event_id"], 500, 3)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


def matched_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    kept = fr.matched_sample(rows, ["l_quantity"], "returned", ["l_orderkey", "l_linenumber"], 1)
    return kept.groupBy("l_quantity", "returned").agg(F.count("*").alias("n"))


def ragged_offsets(spark, sf_dir):
    from chronoweave.sources.payloads import ragged_index

    rows = samples(spark, sf_dir).select(*RUN, "sample_index", F.array_repeat(F.array(F.lit(0.0)), F.col("event_id").cast("int") % 4).alias("values"))
    return ragged_index(rows, RUN).select(*RUN, "sample_index", "begin", "end")


def jsonl_offsets(spark, sf_dir):
    from chronoweave.sources.payloads import json_lines

    rows = samples(spark, sf_dir).select(*RUN, "sample_index", F.from_json("props", "map<string,string>").alias("payload"))
    return json_lines(rows, RUN).select(*RUN, "sample_index", "offset", "nbytes")


# embeddings as clouds and poses: 51 of the 64 numbers are 17 joints, the rest a cloud of points
def _bodies(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: g.at(F.col("embedding"), i).cast("double")
    joints = F.array(*[F.array(*[v(3 * j + a) for a in range(3)]) for j in range(17)])
    points = F.array(*[F.array(*[v(6 * p + a) for a in range(6)]) for p in range(10)])
    return e.select("vec_id", "label", joints.alias("pose"), points.alias("points"))


def skeleton_distance(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("vec_id", F.posexplode("points").alias("pos", "p"), "pose")
    return pose.skeleton_distances(rows, ["vec_id", "pos"], "p", "pose").select("vec_id", "pos", F.round("d", 6).alias("distance"))


def limb_distance(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    return rows.select("vec_id", F.posexplode("points").alias("pos", "p"), "pose").select("vec_id", "pos", F.round(g.segment_distance(F.col("p"), g.at(F.col("pose"), 0), g.at(F.col("pose"), 1)), 6).alias("distance"))


def world_points(spark, sf_dir):
    moved = _bodies(spark, sf_dir).select("vec_id", F.posexplode(g.to_world(F.col("points"))).alias("pos", "p"))
    return moved.select("vec_id", "pos", *[F.round(g.at(F.col("p"), i), 6).alias(n) for i, n in enumerate(("x", "y", "z", "doppler"))])


def projected_points(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("vec_id", F.posexplode("points").alias("pos", "p"))
    far = F.array(g.at(F.col("p"), 0), g.at(F.col("p"), 1), F.abs(g.at(F.col("p"), 2)) + 2.0)
    seen = rows.select("vec_id", "pos", g.project(F.transform(far, lambda x: x * 1000)).alias("uv"))
    return seen.select("vec_id", "pos", F.round(g.at(F.col("uv"), 0), 4).alias("u"), F.round(g.at(F.col("uv"), 1), 4).alias("v"))


def joint_statistics(spark, sf_dir):
    out = pose.joint_statistics(_bodies(spark, sf_dir), [], "pose")
    return out.select("frame", "joint", "axis", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p99")])


def _pairs(spark, sf_dir):
    a = _bodies(spark, sf_dir).select("label", "vec_id", "pose")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pose").alias("truth"))
    return a.join(b, "vec_id").withColumnRenamed("pose", "pred")


def pose_metrics(spark, sf_dir):
    out = pose.pose_metrics(_pairs(spark, sf_dir), ["label"], joints=tuple(range(17)), aligned=False)
    return out.select("label", "frames", *[F.round(c, 5).alias(c) for c in ("mpjpe_mm", "root_relative_mpjpe_mm", "median_joint_error_mm", "pck_50mm", "pck_100mm", "pck_150mm")])


def pose_metrics_aligned(spark, sf_dir):
    return pose.pose_metrics(_pairs(spark, sf_dir), ["label"], joints=g.BODY15)


def geometric_median(spark, sf_dir):
    return _bodies(spark, sf_dir).select("vec_id", pose.geometric_median("points").alias("median"))


def farthest_points(spark, sf_dir):
    return _bodies(spark, sf_dir).select("vec_id", pose.farthest_points(4)("points").alias("points"))


def axis_search(spark, sf_dir):
    return pose.axis_search(_bodies(spark, sf_dir), "vec_id", "points", "pose")


def pose_axis_search(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    return pose.pose_axis_search(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), "pose")


def point_axis_search(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("label", F.explode("points").alias("point"))
    return pose.point_axis_search(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), "point")


#: Consecutive vectors in a block: the groups of theil_sen stay this small on any table.
BLOCK = 500


def theil_sen(spark, sf_dir):
    """Over every vector, an anchor per label and block."""
    block = F.floor(F.col("vec_id") / BLOCK).cast("long")
    rows = _bodies(spark, sf_dir).select("label", block.alias("block"), ((F.col("vec_id") - block * BLOCK - BLOCK // 2) / (BLOCK / 2)).alias("relative_time"), g.at(F.col("points"), 0).alias("anchor"))
    out = pose.theil_sen_anchor(rows, ["label", "block"])
    return out.select("label", "block", "axis", F.round("value", 6).alias("value"))


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_PTS = "pts AS (SELECT vec_id, p AS pos, v[6*p+1] AS x, v[6*p+2] AS y, v[6*p+3] AS z, v[6*p+4] AS d, v FROM e, range(0, 10) AS r(p))"
_JOINTS = "j AS (SELECT vec_id, label, k AS joint, v[3*k+1] AS x, v[3*k+2] AS y, v[3*k+3] AS z, v[1] AS rx, v[2] AS ry, v[3] AS rz FROM e, range(0, 17) AS r(k))"


def _project_sql() -> str:
    c = g.COLOUR_CAMERA
    row = lambda i: " + ".join(f"{c.rotation[i][j]!r}::DOUBLE * {n}" for j, n in enumerate("xyz")) + f" + {c.translation[i]!r}::DOUBLE"
    k = [f"{x!r}::DOUBLE" for x in c.k]
    return f"""
WITH {_E}, {_PTS}, f AS (SELECT vec_id, pos, x * 1000 AS x, y * 1000 AS y, (abs(z) + 2.0) * 1000 AS z FROM pts),
q AS (SELECT vec_id, pos, {row(0)} AS a, {row(1)} AS b, {row(2)} AS c FROM f), n AS (SELECT *, a / c AS x, b / c AS y, (a / c) * (a / c) + (b / c) * (b / c) AS r FROM q),
d AS (SELECT *, (1 + r * ({k[0]} + r * ({k[1]} + r * {k[2]}))) / (1 + r * ({k[3]} + r * ({k[4]} + r * {k[5]}))) AS d FROM n)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x * d + (r + 2*x*x) * {c.p2!r}::DOUBLE + 2*x*y * {c.p1!r}::DOUBLE) * {c.fx!r}::DOUBLE + {c.cx!r}::DOUBLE, 4) AS u,
       round((y * d + (r + 2*y*y) * {c.p1!r}::DOUBLE + 2*x*y * {c.p2!r}::DOUBLE) * {c.fy!r}::DOUBLE + {c.cy!r}::DOUBLE, 4) AS v FROM d"""


_COS, _SIN = (repr(x) for x in (g.sensor_rotation()[1][1], g.sensor_rotation()[1][2]))
_ISLANDS = f"""
WITH {SAMPLES}, m AS (SELECT user_id, event_type, sample_index, value > 50 AS high, lag(value > 50) OVER w AS was, row_number() OVER w AS k FROM samples WINDOW w AS (PARTITION BY user_id, event_type ORDER BY sample_index)),
s AS (SELECT *, sum(CASE WHEN k = 1 OR high IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY sample_index) - 1 AS segment_index FROM m),
seg AS (SELECT user_id, event_type, CAST(segment_index AS BIGINT) AS segment_index, any_value(high) AS high, min(sample_index) AS start, max(sample_index) + 1 AS stop, count(*) AS n FROM s GROUP BY ALL)"""

_LIMB_ROWS = ", ".join(f"({a}, {b})" for a, b in g.LIMBS)

SQL = {
    "skeleton_distance": f"""
WITH {_E}, {_PTS}, limbs AS (SELECT * FROM (VALUES {_LIMB_ROWS}) t(a, b)),
s AS (SELECT vec_id, pos, x - v[3*a+1] AS px, y - v[3*a+2] AS py, z - v[3*a+3] AS pz, v[3*b+1] - v[3*a+1] AS bx, v[3*b+2] - v[3*a+2] AS dy, v[3*b+3] - v[3*a+3] AS bz FROM pts, limbs),
t AS (SELECT *, CASE WHEN bx*bx + dy*dy + bz*bz < 1e-12 THEN 0 ELSE greatest(0.0, least(1.0, (px*bx + py*dy + pz*bz) / (bx*bx + dy*dy + bz*bz))) END AS t FROM s)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(min(sqrt(pow(px - t*bx, 2) + pow(py - t*dy, 2) + pow(pz - t*bz, 2))), 6) AS distance FROM t GROUP BY ALL""",
    "index_window": f"WITH {SAMPLES} SELECT user_id, event_type, sample_index, array_to_string(list(event_id ORDER BY sample_index) OVER (PARTITION BY user_id, event_type ORDER BY sample_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS ids FROM samples",
    "index_range": f"WITH {SAMPLES} SELECT user_id, event_type, string_agg(event_id || ',' || sample_index, ',' ORDER BY sample_index) AS ids FROM samples WHERE sample_index BETWEEN 2 AND 4 GROUP BY ALL",
    "strided_windows": f"""
WITH {SAMPLES}, c AS (SELECT user_id, sample_index AS k, unnest([-1, 0, 1]) AS o FROM samples WHERE event_type = 'click'),
m AS (SELECT c.user_id, c.k, count(v.event_id) AS n, max(CASE WHEN o = 0 THEN v.event_id END) AS mid FROM c LEFT JOIN samples v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.sample_index = c.k + 2 * c.o GROUP BY ALL)
SELECT user_id, k AS target_sample_index, n AS n_frames, n AS window_points, CASE WHEN n < 3 THEN 'incomplete_radar_window' ELSE 'ok' END AS status FROM m""",
    "change_segments": _ISLANDS + " SELECT * FROM seg",
    "valid_centres": _ISLANDS + " SELECT user_id, event_type, unnest(range(start + 1, stop - 1)) AS centre FROM seg WHERE stop - start >= 3",
    "sliding_support": f"WITH {SAMPLES} SELECT user_id, event_type, sample_index, CAST(sum(CAST(value > 50 AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY sample_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS support FROM samples",
    "temporal_split": f"""
WITH {SAMPLES}, a AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sample_index DESC) AS k FROM samples WINDOW w AS (PARTITION BY user_id, event_type)),
h AS (SELECT *, k <= least(greatest(round_even(n * 0.2::DOUBLE, 0), 1), n - 2) AS held FROM a), b AS (SELECT *, min(CASE WHEN held THEN sample_index - 1 END) OVER (PARTITION BY user_id, event_type) AS s FROM h)
SELECT user_id, event_type, sample_index, CASE WHEN held THEN 'validation' WHEN sample_index + 1 < s THEN 'training' ELSE 'gap' END AS part FROM b""",
    "calibration_split": f"""
WITH {SAMPLES}, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM samples)
SELECT event_id, CASE WHEN k <= CASE WHEN n >= 11 THEN least(greatest(10, round_even(n * 0.3::DOUBLE, 0)), n - 1) ELSE greatest(1, n - 1) END THEN 'calibration' ELSE 'evaluation' END AS part FROM a""",
    "lag_sweep": f"""
WITH {SAMPLES}, c AS (SELECT user_id, sample_index, value FROM samples WHERE event_type = 'click')
SELECT a.user_id, CAST(s AS INTEGER) AS shift, round(avg(abs(a.value - b.value)) * 1000, 3) AS error_mm, count(*) AS frames FROM c a, range(-2, 3) AS r(s), c b WHERE b.user_id = a.user_id AND b.sample_index = a.sample_index + s GROUP BY ALL""",
    "even_subsample": f"""
WITH {SAMPLES}, a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM samples)
SELECT event_id, event_type FROM a WHERE n <= 101 OR i IN (SELECT CAST(floor(j * (a.n - 1) / 100.0::DOUBLE + 1e-9) AS BIGINT) FROM range(0, 101) AS r(j))""",
    "stratified_cap": "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, CAST(least(n, greatest(1, round_even(500 * n / (SELECT sum(n) FROM n), 0))) AS BIGINT) AS n FROM n",
    "matched_sample": "SELECT l_quantity, unnest([TRUE, FALSE]) AS returned, n FROM (SELECT l_quantity, least(count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag <> 'R')) AS n FROM lineitem GROUP BY l_quantity) WHERE n > 0",
    "ragged_offsets": f"WITH {SAMPLES}, s AS (SELECT *, sum(event_id % 4) OVER (PARTITION BY user_id, event_type ORDER BY sample_index) AS e FROM samples) SELECT user_id, event_type, sample_index, CAST(e - event_id % 4 AS BIGINT) AS begin, CAST(e AS BIGINT) AS \"end\" FROM s",
    "jsonl_offsets": f"""
WITH {SAMPLES}, s AS (SELECT *, octet_length(encode('{{"payload":{{"k":"' || (props->>'k') || '"}},"sample_index":' || sample_index || '}}')) AS n FROM samples)
SELECT user_id, event_type, sample_index, CAST(sum(n + 1) OVER (PARTITION BY user_id, event_type ORDER BY sample_index) - n - 1 AS BIGINT) AS "offset", n AS nbytes FROM s""",
    "limb_distance": f"""
WITH {_E}, {_PTS}, s AS (SELECT vec_id, pos, x, y, z, v[1] AS ax, v[2] AS ay, v[3] AS az, v[4] - v[1] AS bx, v[5] - v[2] AS "by", v[6] - v[3] AS bz FROM pts),
t AS (SELECT *, bx*bx + "by"*"by" + bz*bz AS l, greatest(0.0, least(1.0, ((x-ax)*bx + (y-ay)*"by" + (z-az)*bz) / (bx*bx + "by"*"by" + bz*bz))) AS t FROM s)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(sqrt(pow(x-ax-t*bx, 2) + pow(y-ay-t*"by", 2) + pow(z-az-t*bz, 2)), 6) AS distance FROM t""",
    "world_points": f"WITH {_E}, {_PTS} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x, round(y * {_COS}::DOUBLE + z * {_SIN}::DOUBLE, 6) AS y, round(z * {_COS}::DOUBLE - y * {_SIN}::DOUBLE + 1.76, 6) AS z, round(d, 6) AS doppler FROM pts",
    "projected_points": _project_sql(),
    "joint_statistics": f"""
WITH {_E}, {_JOINTS}, l AS (SELECT 'absolute' AS frame, joint, unnest([0, 1, 2]) AS axis, unnest([x, y, z]) AS value FROM j UNION ALL SELECT 'root_relative', joint, unnest([0, 1, 2]), unnest([x - rx, y - ry, z - rz]) FROM j)
SELECT frame, CAST(joint AS INTEGER) AS joint, CAST(axis AS INTEGER) AS axis, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM l GROUP BY ALL""",
    "pose_metrics": f"""
WITH {_E}, {_JOINTS}, m AS (SELECT a.label, a.vec_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS e, sqrt(pow(a.x-a.rx-b.x+b.rx,2)+pow(a.y-a.ry-b.y+b.ry,2)+pow(a.z-a.rz-b.z+b.rz,2)) AS r FROM j a JOIN j b ON b.vec_id = a.vec_id + 1 AND b.joint = a.joint)
SELECT label, count(DISTINCT vec_id) AS frames, round(avg(e) * 1000, 5) AS mpjpe_mm, round(avg(r) * 1000, 5) AS root_relative_mpjpe_mm, round(quantile_cont(e, 0.5) * 1000, 5) AS median_joint_error_mm,
       round(avg(CAST(e <= 0.05 AS INT)), 5) AS pck_50mm, round(avg(CAST(e <= 0.1 AS INT)), 5) AS pck_100mm, round(avg(CAST(e <= 0.15 AS INT)), 5) AS pck_150mm FROM m GROUP BY label""",
    "theil_sen": f"""
WITH {_E}, b AS (SELECT label, CAST(floor(vec_id / {BLOCK}::DOUBLE) AS BIGINT) AS block, vec_id, v FROM e),
a AS (SELECT label, block, (vec_id - block * {BLOCK} - {BLOCK // 2}) / {BLOCK / 2}::DOUBLE AS t, unnest([0, 1, 2]) AS axis, unnest([v[1], v[2], v[3]]) AS y FROM b),
s AS (SELECT a.label, a.block, a.axis, median((b.y - a.y) / (b.t - a.t)) AS m FROM a JOIN a b ON a.label = b.label AND a.block = b.block AND a.axis = b.axis AND b.t - a.t > 1e-12 GROUP BY ALL)
SELECT a.label, a.block, CAST(a.axis AS INTEGER) AS axis, round(median(y - coalesce(m, 0) * t), 6) AS value FROM a LEFT JOIN s ON a.label = s.label AND a.block = s.block AND a.axis = s.axis GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (
    index_window, index_range, strided_windows, change_segments, valid_centres, sliding_support, temporal_split, calibration_split, lag_sweep, even_subsample, stratified_cap, matched_sample, ragged_offsets, jsonl_offsets,
    skeleton_distance, limb_distance, world_points, projected_points, joint_statistics, pose_metrics, pose_metrics_aligned, geometric_median, farthest_points, axis_search, pose_axis_search, point_axis_search, theil_sen,
)}
