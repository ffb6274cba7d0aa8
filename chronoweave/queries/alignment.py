"""Nearest mappings, timelines, clock models, lookups and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.names import asset_id, is_absolute_path, normalise_asset_ref, slugify, version_id
from chronoweave.functions.times import format_datetime, from_epoch_seconds, micros, parse_datetime
from chronoweave.operators import nearest, piecewise, timelines
from chronoweave.operators.lookup import nearest_by_time, source_of_target, target_of_source
from chronoweave.plans.audit import audit
from chronoweave.queries.data import ANCHORS, RUN, SAMPLES, SEGMENTS, SPARSE, anchors, of_type, samples, stored_samples, table
from chronoweave.sources.shared import written
from chronoweave.sources.store import upserted
from chronoweave.sources.validation import duplicate_keys, null_required

HOUR = 3_600_000.0
#: Events lie days apart: support limits in hours.
CONFIG = nearest.NearestConfig(top_k=3, weak_ms=12 * HOUR, max_ms=72 * HOUR, source_window_policy="all")
WINDOW = nearest.NearestConfig(top_k=2, weak_ms=12 * HOUR, max_ms=72 * HOUR, source_margin_ms=24 * HOUR, extrapolation_policy="allow_linear")
WITHIN = nearest.NearestConfig(top_k=1, weak_ms=12 * HOUR, max_ms=72 * HOUR, primary_policy="within_max_delta")


def _nearest_sql(k: int, where: str = "TRUE", beyond: str = "outside_run", primary: str = "support_status = 'supported'", more: str = "") -> str:
    return f"""
WITH {SAMPLES},
span AS (SELECT user_id, min(t) AS t_min, max(t) AS t_max FROM samples WHERE event_type = 'purchase' GROUP BY user_id),
ranked AS (
  SELECT s.user_id, s.sample_index AS source_sample_index, g.sample_index AS target_sample_index, s.t AS source_t, g.t AS target_t, t_min, t_max, g.t - s.t AS delta_us,
         row_number() OVER (PARTITION BY s.user_id, s.sample_index ORDER BY abs(g.t - s.t), g.t, g.sample_index) AS rank
  FROM samples s JOIN samples g ON s.user_id = g.user_id JOIN span ON s.user_id = span.user_id
  WHERE s.event_type = 'click' AND g.event_type = 'purchase'
),
matched AS (
  SELECT *, delta_us / 1000.0 AS delta_ms,
         CASE WHEN source_t < t_min THEN 'left_extrapolation' WHEN source_t > t_max THEN 'right_extrapolation' ELSE 'interpolation' END AS mapping_region_type
  FROM ranked WHERE rank <= {k} AND {where}
),
supported AS (
  SELECT *, CASE WHEN mapping_region_type <> 'interpolation' THEN '{beyond}' WHEN abs(delta_ms) > 43200000 THEN 'weak_support' ELSE 'supported' END AS support_status FROM matched
),
mapping AS (
  SELECT user_id, source_sample_index, target_sample_index, CAST(rank AS INTEGER) AS rank, delta_ms, mapping_region_type, support_status, target_t,
         rank = 1 AND {primary} AS is_primary,
         CASE WHEN support_status = 'outside_run' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0 - abs(delta_ms) / 259200000.0)), 9) END AS confidence_score
  FROM supported
){more}
"""


_MAPPING = "user_id source_sample_index target_sample_index rank delta_ms mapping_region_type support_status is_primary confidence_score".split()
_SELECT = f"SELECT {', '.join(_MAPPING)} FROM mapping"


def _mapping(spark: SparkSession, sf_dir: str, config: nearest.NearestConfig, rows: DataFrame | None = None) -> DataFrame:
    rows = stored_samples(spark, sf_dir) if rows is None else rows
    return nearest.nearest_mapping(of_type(rows, "click"), of_type(rows, "purchase"), ["user_id"], config, SPARSE)


def _shown(mapping: DataFrame) -> DataFrame:
    return mapping.withColumn("confidence_score", F.round("confidence_score", 9)).select(_MAPPING)


def nearest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every click the three nearest purchases of the same user, with support, primary flag and confidence."""
    return _shown(_mapping(spark, sf_dir, CONFIG))


def nearest_window_margin(spark, sf_dir):
    return _shown(_mapping(spark, sf_dir, WINDOW))


def nearest_primary_within(spark, sf_dir):
    return _shown(_mapping(spark, sf_dir, WITHIN)).where("is_primary")


def mapping_diagnostics(spark, sf_dir):
    mapping = written(_mapping(spark, sf_dir, CONFIG).withColumn("version", F.lit("v1")), "mapping")
    found = nearest.mapping_diagnostics(mapping.withColumn("target_key", F.lit(0)), ["version"])
    return found.select("metric", F.round("value", 4).alias("value"))


def timeline_coverage(spark, sf_dir):
    return timelines.coverage(samples(spark, sf_dir), RUN)


def overlap_pairs(spark, sf_dir):
    cover = timelines.coverage(samples(spark, sf_dir), RUN)
    source, target = (cover.where(F.col("event_type").isin(*k)) for k in (("click", "view"), ("purchase", "signup")))
    pairs = timelines.overlap_pairs(source, target, ["user_id"], "event_type", min_overlap_sec=86_400 * 5)
    return pairs.select("user_id", "source_event_type", "target_event_type", F.round("overlap_sec", 6).alias("overlap_sec"), "status")


def sample_numbers(spark, sf_dir):
    return samples(spark, sf_dir).select(*RUN, "event_id", "sample_index", "t")


def ols_timeline(spark, sf_dir):
    fits = timelines.fit_lines(samples(spark, sf_dir), RUN, "sample_index", "t")
    return fits.select(*RUN, "origin_us", F.round("slope", 3).alias("slope"), F.round("intercept_sec", 3).alias("intercept_sec"), "n", F.round("rmse_ms", 0).alias("rmse_ms"))


def ols_residuals(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = timelines.fitted_times(rows, timelines.fit_lines(rows, RUN, "sample_index", "t"), RUN, "sample_index", "t")
    return out.select(*RUN, "sample_index", F.round(F.col("residual_ms") / 1000, 3).alias("residual_sec"))


def ols_report(spark, sf_dir):
    rep = timelines.fit_report(timelines.fit_lines(samples(spark, sf_dir), RUN, "sample_index", "t"), RUN)
    # residuals of fits to whole microseconds: a millisecond carries what the two engines' sums differ by
    digits = F.when(F.col("metric") == "rmse_ms", F.round("value", 0)).when(F.col("metric") == "fps_est", F.round("value", 9)).otherwise(F.round("value", 3))
    return rep.select(*RUN, "metric", digits.alias("value"))


def run_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return timelines.run_summary(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def first_per_key(spark, sf_dir):
    return timelines.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def anchor_pairs(spark, sf_dir, pick=anchors):
    return pick(stored_samples(spark, sf_dir))


def piecewise_segments(spark, sf_dir, pick=anchors):
    s = piecewise.fit_segments(written(pick(stored_samples(spark, sf_dir)), "anchors"), ["user_id"], SPARSE)
    return s.select("user_id", F.col("segment_index").cast("long").alias("segment_index"), "left_anchor_id", "right_anchor_id", F.round("slope", 9).alias("slope"))


def _predicted(spark, sf_dir, policy, pick):
    rows = stored_samples(spark, sf_dir)
    segments = piecewise.fit_segments(written(pick(rows), "anchors"), ["user_id"], SPARSE)
    times = of_type(rows, "click").select("user_id", "sample_index", (F.col("t") / 1e6).alias("source_time"))
    out = piecewise.predict(times, segments, ["user_id"], policy, SPARSE)
    return out.select("user_id", "sample_index", F.round("target_time", 3).alias("target_time"), "region", F.col("segment_index").cast("long").alias("segment_index"))


def piecewise_predict(spark, sf_dir, pick=anchors):
    return _predicted(spark, sf_dir, "allow_linear", pick)


def piecewise_predict_inside(spark, sf_dir, pick=anchors):
    return _predicted(spark, sf_dir, "disallow", pick)


def piecewise_residuals(spark, sf_dir, pick=anchors):
    a = written(pick(stored_samples(spark, sf_dir)), "anchors")
    out = piecewise.anchor_residuals(a, piecewise.fit_segments(a, ["user_id"], SPARSE), ["user_id"], SPARSE)
    return out.select("user_id", "anchor_id", F.round("residual_ms", 1).alias("residual_ms"), "region")


def piecewise_loo(spark, sf_dir, pick=anchors):
    out = piecewise.leave_one_out(written(pick(stored_samples(spark, sf_dir)), "anchors"), ["user_id"], SPARSE)
    return out.select("user_id", "anchor_id", "status", F.round(F.col("error_ms") / 1000, 2).alias("error_sec"))


def piecewise_mapping(spark, sf_dir, pick=anchors):
    rows = stored_samples(spark, sf_dir)
    segments = piecewise.fit_segments(written(pick(rows), "anchors"), ["user_id"], SPARSE)
    out = piecewise.piecewise_mapping(of_type(rows, "click"), of_type(rows, "purchase"), segments, ["user_id"], CONFIG, "allow_linear", SPARSE)
    return out.select("user_id", "source_sample_index", "rank", "target_sample_index", F.round(F.col("delta_ms") / 1000, 1).alias("delta_sec"), "region", "support_status")


def lookup_forward(spark, sf_dir):
    mapping = _mapping(spark, sf_dir, CONFIG)
    return target_of_source(mapping, mapping.select("user_id", "source_sample_index").distinct(), ["user_id"]).select("user_id", "source_sample_index", "target_sample_index", "rank")


def lookup_inverse(spark, sf_dir):
    rows = stored_samples(spark, sf_dir)
    wanted = of_type(rows, "purchase").select("user_id", F.col("sample_index").alias("target_sample_index"))
    # a lookup carries whole rows of the mapping with each target: only what decides and what is asked for
    mapping = written(_mapping(spark, sf_dir, CONFIG, rows).select("user_id", "source_sample_index", "target_sample_index", "is_primary", "rank", "delta_ms"), "mapping")
    return source_of_target(mapping, wanted, ["user_id"]).select("user_id", "target_sample_index", "source_sample_index", "distance")


def lookup_by_time(spark, sf_dir):
    rows = samples(spark, sf_dir)
    wanted = of_type(rows, "signup").select("user_id", F.col("sample_index").alias("query"), "t")
    return nearest_by_time(of_type(rows, "click"), wanted, ["user_id"], "query").select("user_id", "query", "sample_index")


def upsert_left_anti(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("note"))
    new = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id", F.lit("new").alias("note"))
    return upserted(rows, new, ["doc_id"])


def duplicate_key_rows(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"], "events")


def null_required_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return null_required(rows, ["doc_id", "lang", "quality", "toxic"], "documents")


def missing_summary(spark, sf_dir):
    """Documents as samples with payloads, labels as their summaries, through the audit."""
    key = lambda n: [F.lit("s").alias("subject_id"), F.lit("r").alias("run_id"), F.lit("d").alias("device_type"), F.col(n).alias("sample_index")]
    rows = table(spark, sf_dir, "documents").select(*key("doc_id"), F.lit("text").alias("artifact_role"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("artifact_ref"))
    done = table(spark, sf_dir, "labels").select(*key("doc_id"))
    assets = rows.limit(1).select("subject_id", "run_id", "device_type", F.lit("text").alias("asset_role"), F.lit("external").alias("storage_key"), F.col("artifact_ref").alias("asset_ref"))
    found = audit(assets, rows, done, files=rows.select(F.col("artifact_ref").alias("ref")))
    return found.select("severity", F.col("table").alias("table_name"), F.col("sample_index").alias("doc_id"))


def slugs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", slugify(F.col("text"), 30).alias("slug"), asset_id(F.col("source"), F.col("lang"), F.lit("a b"), F.lit("")).alias("asset"), version_id((F.col("source"), 40), (F.col("lang"), 30)).alias("version"))


def asset_refs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    raw = F.concat(F.lit(" ./runs\\"), F.regexp_replace("url", "^https?:", ""), F.lit("//./cam\\/x/ "))
    return p.select("page_id", normalise_asset_ref(raw).alias("ref"), is_absolute_path(F.concat(F.lit("/"), F.col("url"))).alias("absolute"), is_absolute_path(F.col("url")).alias("relative"))


def time_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = format_datetime(e["ts"])
    return e.select("event_id", text.alias("text"), micros(parse_datetime(text)).alias("us"), micros(from_epoch_seconds(micros(e["ts"]) / 1e6 + 0.25)).alias("later"))


_FIT = f"""
WITH {SAMPLES},
based AS (SELECT *, min(t) OVER (PARTITION BY user_id, event_type) AS origin_us FROM samples),
fits AS (
  SELECT user_id, event_type, origin_us, regr_slope((t - origin_us) / 1e6, sample_index) AS slope,
         regr_intercept((t - origin_us) / 1e6, sample_index) AS intercept_sec, count(*) AS n
  FROM based GROUP BY ALL HAVING count(*) >= 2
),
res AS (
  SELECT b.user_id, b.event_type, b.sample_index, (b.t - b.origin_us) / 1e6 - (slope * sample_index + intercept_sec) AS r
  FROM based b JOIN fits f ON b.user_id = f.user_id AND b.event_type = f.event_type
)"""

_PREDICT = f"""
WITH RECURSIVE {SAMPLES}, {ANCHORS}, {SEGMENTS},
ends AS (SELECT user_id, min(source_start) AS lo, max(source_end) AS hi, max(segment_index) AS last FROM segments GROUP BY user_id),
clicks AS (SELECT user_id, sample_index, t / 1e6 AS t FROM samples WHERE event_type = 'click'),
placed AS (
  SELECT c.*, e.lo, e.hi, CASE WHEN c.t < e.lo THEN 0 ELSE (SELECT max(segment_index) FROM segments s WHERE s.user_id = c.user_id AND s.source_start <= c.t) END AS seg
  FROM clicks c LEFT JOIN ends e ON c.user_id = e.user_id
),
predicted AS (
  SELECT p.user_id, p.sample_index, p.t, s.target_start + s.slope * (p.t - s.source_start) AS target_time, seg,
         CASE WHEN lo IS NULL THEN 'unsupported' WHEN p.t < lo THEN 'left_extrapolation' WHEN p.t > hi THEN 'right_extrapolation' ELSE 'interpolation' END AS region
  FROM placed p LEFT JOIN segments s ON s.user_id = p.user_id AND s.segment_index = p.seg
)"""

_BEST = _nearest_sql(3, more=""",
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_sample_index ORDER BY is_primary DESC, rank, abs(delta_ms), target_sample_index) AS n FROM mapping)
SELECT user_id, source_sample_index, target_sample_index, rank FROM best WHERE n = 1""")

_INVERSE = _nearest_sql(3, more=""",
wanted AS (SELECT user_id, sample_index AS wanted FROM samples WHERE event_type = 'purchase'),
near AS (
  SELECT w.user_id, w.wanted, m.*, abs(m.target_sample_index - w.wanted) AS distance,
         row_number() OVER (PARTITION BY w.user_id, w.wanted ORDER BY abs(m.target_sample_index - w.wanted), m.source_sample_index, m.target_sample_index) AS n
  FROM wanted w JOIN mapping m ON m.user_id = w.user_id
),
exact AS (SELECT user_id, wanted, bool_or(distance = 0) AS hit FROM near GROUP BY ALL),
cut AS (SELECT near.* FROM near JOIN exact ON near.user_id = exact.user_id AND near.wanted = exact.wanted WHERE (hit AND distance = 0) OR (NOT hit AND n <= 20)),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, wanted ORDER BY is_primary DESC, rank, abs(delta_ms), source_sample_index, target_sample_index) AS k FROM cut)
SELECT user_id, wanted AS target_sample_index, source_sample_index, distance FROM best WHERE k = 1""").replace("w.user_id, w.wanted, m.*, abs", "w.wanted, m.*, abs")

SQL = {
    "nearest_topk": _nearest_sql(3) + _SELECT,
    "nearest_window_margin": _nearest_sql(2, "source_t BETWEEN t_min - 86400000000 AND t_max + 86400000000", "extrapolated") + _SELECT,
    "nearest_primary_within": _nearest_sql(1, "source_t BETWEEN t_min AND t_max", primary="support_status <> 'outside_run' AND abs(delta_ms) <= 259200000") + _SELECT + " WHERE is_primary",
    "mapping_diagnostics": _nearest_sql(3) + """
SELECT metric, round(value, 4) AS value FROM (
  SELECT unnest(['sample_mapping_rows', 'primary_rows', 'mapped_sources', 'primary_targets', 'primary_abs_delta_ms_median', 'primary_abs_delta_ms_p95', 'primary_abs_delta_ms_max']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (WHERE is_primary), count(DISTINCT source_sample_index), count(DISTINCT CASE WHEN is_primary THEN target_sample_index END),
                 quantile_cont(CASE WHEN is_primary THEN abs(delta_ms) END, 0.5), quantile_cont(CASE WHEN is_primary THEN abs(delta_ms) END, 0.95), max(CASE WHEN is_primary THEN abs(delta_ms) END)]) AS value
  FROM mapping
  UNION ALL SELECT 'support_status:' || support_status, CAST(count(*) AS DOUBLE) FROM mapping GROUP BY support_status)""",
    "timeline_coverage": f"WITH {SAMPLES} SELECT user_id, event_type, min(t) AS t_min, max(t) AS t_max, count(*) AS n FROM samples GROUP BY ALL",
    "overlap_pairs": f"""
WITH {SAMPLES}, c AS (SELECT user_id, event_type, min(t) AS a, max(t) AS b FROM samples GROUP BY ALL),
p AS (SELECT s.user_id, s.event_type AS source_event_type, g.event_type AS target_event_type, (least(s.b, g.b) - greatest(s.a, g.a)) / 1e6 AS o
      FROM c s JOIN c g ON s.user_id = g.user_id WHERE s.event_type IN ('click', 'view') AND g.event_type IN ('purchase', 'signup'))
SELECT user_id, source_event_type, target_event_type, round(o, 6) AS overlap_sec,
       CASE WHEN o <= 0 THEN 'skipped_no_overlap' WHEN o < 432000 THEN 'skipped_below_min_overlap' ELSE 'mapped' END AS status FROM p""",
    "sample_numbers": f"WITH {SAMPLES} SELECT user_id, event_type, event_id, sample_index, t FROM samples",
    "ols_timeline": _FIT + """
SELECT f.user_id, f.event_type, origin_us, round(slope, 3) AS slope, round(intercept_sec, 3) AS intercept_sec, n, round(sqrt(avg(r * r)) * 1000, 0) AS rmse_ms
FROM fits f JOIN res ON f.user_id = res.user_id AND f.event_type = res.event_type GROUP BY ALL""",
    "ols_residuals": _FIT + " SELECT user_id, event_type, sample_index, round(r, 3) AS residual_sec FROM res",
    "ols_report": _FIT + " SELECT user_id, event_type, 'num_fit_points' AS metric, CAST(n AS DOUBLE) AS value FROM fits UNION ALL SELECT user_id, event_type, 'slope_sec', round(slope, 3) FROM fits UNION ALL SELECT user_id, event_type, 'intercept_sec', round(intercept_sec, 3) FROM fits UNION ALL SELECT user_id, event_type, 'rmse_ms', round(sqrt(avg(r * r)) * 1000, 0) FROM res GROUP BY ALL UNION ALL SELECT user_id, event_type, 'fps_est', CASE WHEN slope <> 0 THEN round(1 / slope, 9) END FROM fits",
    "run_summary": "SELECT c_custkey, c_name, count(o_orderkey) AS num_samples FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "first_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "anchor_pairs": f"WITH RECURSIVE {SAMPLES}, {ANCHORS} SELECT user_id, anchor_id, sample_index, source_time, target_time FROM anchors",
    "piecewise_segments": f"WITH RECURSIVE {SAMPLES}, {ANCHORS}, {SEGMENTS} SELECT user_id, segment_index, left_anchor_id, right_anchor_id, round(slope, 9) AS slope FROM segments",
    "piecewise_predict": _PREDICT + " SELECT user_id, sample_index, round(target_time, 3) AS target_time, region, CASE WHEN region <> 'unsupported' THEN seg END AS segment_index FROM predicted",
    "piecewise_predict_inside": _PREDICT + """
SELECT user_id, sample_index, CASE WHEN region = 'interpolation' THEN round(target_time, 3) END AS target_time,
       CASE WHEN region = 'interpolation' THEN region ELSE 'unsupported' END AS region, CASE WHEN region = 'interpolation' THEN seg END AS segment_index FROM predicted""",
    "piecewise_residuals": f"""
WITH RECURSIVE {SAMPLES}, {ANCHORS}, {SEGMENTS},
pl AS (SELECT a.*, (SELECT max(segment_index) FROM segments s WHERE s.user_id = a.user_id AND s.source_start <= a.source_time) AS seg FROM anchors a)
SELECT pl.user_id, anchor_id, round((target_start + slope * (source_time - source_start) - target_time) * 1000, 1) + 0.0 AS residual_ms, 'interpolation' AS region
FROM pl JOIN segments s ON s.user_id = pl.user_id AND s.segment_index = pl.seg""",
    "piecewise_loo": f"""
WITH RECURSIVE {SAMPLES}, {ANCHORS},
w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER o AS k,
        lag(source_time) OVER o AS s1, lead(source_time) OVER o AS n1, lag(source_time, 2) OVER o AS s2, lead(source_time, 2) OVER o AS n2,
        lag(target_time) OVER o AS g1, lead(target_time) OVER o AS h1, lag(target_time, 2) OVER o AS g2, lead(target_time, 2) OVER o AS h2
      FROM anchors WINDOW o AS (PARTITION BY user_id ORDER BY source_time, anchor_id)),
l AS (SELECT *, CASE WHEN k = 1 THEN n1 WHEN k = n THEN s2 ELSE s1 END AS xs, CASE WHEN k = 1 THEN h1 WHEN k = n THEN g2 ELSE g1 END AS ys,
             CASE WHEN k = 1 THEN n2 WHEN k = n THEN s1 ELSE n1 END AS xe, CASE WHEN k = 1 THEN h2 WHEN k = n THEN g1 ELSE h1 END AS ye FROM w)
SELECT user_id, anchor_id, CASE WHEN n > 2 THEN 'ok' ELSE 'insufficient_training_anchors' END AS status,
       CASE WHEN n > 2 THEN round(ys + (ye - ys) / (xe - xs) * (source_time - xs) - target_time, 2) END AS error_sec FROM l""",
    "piecewise_mapping": _PREDICT + """,
ranked AS (
  SELECT p.user_id, p.sample_index AS source_sample_index, g.sample_index AS target_sample_index, p.region, (g.t - CAST(round_even(p.target_time * 1e6, 0) AS BIGINT)) / 1000.0 AS delta_ms,
         row_number() OVER (PARTITION BY p.user_id, p.sample_index ORDER BY abs(g.t - CAST(round_even(p.target_time * 1e6, 0) AS BIGINT)), g.t, g.sample_index) AS rank
  FROM predicted p JOIN samples g ON g.user_id = p.user_id AND g.event_type = 'purchase' WHERE p.region <> 'unsupported')
SELECT user_id, source_sample_index, CAST(rank AS INTEGER) AS rank, target_sample_index, round(delta_ms / 1000, 1) AS delta_sec, region,
       CASE WHEN region <> 'interpolation' THEN 'extrapolated' WHEN abs(delta_ms) > 43200000 THEN 'weak_support' ELSE 'supported' END AS support_status
FROM ranked WHERE rank <= 3""",
    "lookup_forward": _BEST,
    "lookup_inverse": _INVERSE,
    "lookup_by_time": f"""
WITH {SAMPLES}
SELECT user_id, query, sample_index FROM (
  SELECT q.user_id, q.sample_index AS query, s.sample_index, row_number() OVER (PARTITION BY q.user_id, q.sample_index ORDER BY abs(s.t - q.t), s.t, s.sample_index) AS n
  FROM samples q JOIN samples s ON s.user_id = q.user_id WHERE q.event_type = 'signup' AND s.event_type = 'click') WHERE n = 1""",
    "upsert_left_anti": "SELECT doc_id, CAST(quality AS VARCHAR) AS note FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, 'new' FROM documents WHERE lang = 'fr'",
    "duplicate_key_rows": "SELECT 'events' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1)",
    "null_required_counts": """
SELECT 'documents' AS table_name, unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, unnest([a, b, c, d]) AS missing
FROM (SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS a, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS b, count(*) FILTER (WHERE quality IS NULL) AS c, count(*) FILTER (WHERE toxic IS NULL) AS d
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "missing_summary": "SELECT DISTINCT 'warning' AS severity, 'SAMPLE_SUMMARY' AS table_name, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "slugs": r"""
WITH s AS (SELECT doc_id, source, lang, left(trim(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 30) AS slug FROM documents)
SELECT doc_id, CASE WHEN slug = '' THEN 'unknown' ELSE slug END AS slug, 'asset_' || source || '_' || lang || '_a_b_unknown' AS asset, source || '__' || lang AS version FROM s""",
    "asset_refs": r"SELECT page_id, 'runs/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?:', ''), '^/+', ''), '/+$', '') || '/cam/x' AS ref, TRUE AS absolute, FALSE AS relative FROM pages",
    "time_columns": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS text, epoch_us(ts) AS us, epoch_us(ts) + 250000 AS later FROM events",
}

QUERIES = {f.__name__: f for f in (
    nearest_topk, nearest_window_margin, nearest_primary_within, mapping_diagnostics, timeline_coverage, overlap_pairs, sample_numbers, ols_timeline, ols_residuals, ols_report, run_summary,
    first_per_key, anchor_pairs, piecewise_segments, piecewise_predict, piecewise_predict_inside, piecewise_residuals, piecewise_loo, piecewise_mapping, lookup_forward, lookup_inverse,
    lookup_by_time, upsert_left_anti, duplicate_key_rows, null_required_counts, missing_summary, slugs, asset_refs, time_columns,
)}
