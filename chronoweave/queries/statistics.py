"""Distribution statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import statistics as st
from chronoweave.queries.data import table


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("returned"))


def _values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")


def _rounded(df, columns, digits):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def describe(spark, sf_dir):
    out = st.describe(_values(spark, sf_dir), ["event_type"], "value")
    return _rounded(out, [c for c in out.columns if c not in ("event_type", "count")], 6)


def describe_all(spark, sf_dir):
    out = st.describe(_lines(spark, sf_dir), [], "l_extendedprice", (0.05, 0.5, 0.95))
    return _rounded(out, ["min", "mean", "std", "max", "iqr", "p5", "p50", "p95"], 3)


def average_ranks(spark, sf_dir):
    return st.with_ranks(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "avg_rank")


def percentile_ranks(spark, sf_dir):
    out = st.percentile_ranks(_values(spark, sf_dir), ["user_id"], "value", symmetric=True)
    return out.select("event_id", F.round("percentile", 9).alias("percentile"))


def pearson(spark, sf_dir):
    return _rounded(st.paired_corr(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice"), ["corr"], 9)


def spearman(spark, sf_dir):
    return _rounded(st.spearman(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice"), ["spearman"], 9)


def partial_spearman(spark, sf_dir):
    return _rounded(st.partial_spearman(_lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice", "l_discount", "l_quantity"), ["partial_spearman"], 7)


def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "n_chars", (F.col("quality") == 1).alias("good"))
    return _rounded(st.auc(rows, ["lang"], "n_chars", "good"), ["auc"], 9)


def ks(spark, sf_dir):
    return _rounded(st.ks(_lines(spark, sf_dir), [], "l_extendedprice", "returned"), ["ks"], 9)


def wasserstein(spark, sf_dir):
    rows = _values(spark, sf_dir).withColumn("bought", F.col("event_type") == "purchase")
    return _rounded(st.wasserstein(rows, [], "value", "bought"), ["wasserstein"], 6)


def quantile_gap(spark, sf_dir):
    return _rounded(st.quantile_gap(_lines(spark, sf_dir), [], "l_extendedprice", "returned"), ["quantile_gap"], 9)


def quantisation(spark, sf_dir):
    out = st.quantisation(_lines(spark, sf_dir), ["l_returnflag"], "l_discount")
    return _rounded(out, ["entropy_bits", "effective_levels", "min_step", "median_step", "unique_fraction", "zero_fraction", "negative_fraction", "positive_fraction"], 7)


def _scored(spark, sf_dir):
    # a score in (0, 1] and a distance for every line: its discount rank and its price in 100,000s
    return st.percentile_ranks(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity").withColumn("distance", F.col("l_extendedprice") / 100000.0)


def deciles(spark, sf_dir):
    out = st.deciles(_scored(spark, sf_dir), [], "percentile", "distance")
    return _rounded(out, ["within_10", "within_near", "within_30", "p25", "median", "p75"], 5)


def range_bins(spark, sf_dir):
    out = st.range_bins(_lines(spark, sf_dir), [], "l_quantity", [1.0, 10.0, 20.0, 35.0, 50.0], "l_extendedprice", "returned")
    return _rounded(out, ["spearman", "auc"], 7).select("bin", "points", "spearman", "auc")


def minmax(spark, sf_dir):
    out = st.minmax(_values(spark, sf_dir), ["event_type"], "value", reverse=True)
    return out.select("event_id", F.round("scaled", 9).alias("scaled"))


def robust_scale(spark, sf_dir):
    out = st.robust_scale(_values(spark, sf_dir), ["user_id"], "value")
    return out.select("event_id", F.round("robust", 7).alias("robust"))


def support_overlap(spark, sf_dir):
    return _rounded(st.support_overlap(_lines(spark, sf_dir), [], "l_extendedprice", "returned", 0.05, 0.95), ["below", "above", "within"], 9)


def proximity_summary(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("distance", F.col("l_extendedprice") / 100000.0)
    out = st.proximity_summary(rows, "l_discount", "distance", "l_quantity", 0.2, 0.4)
    return _rounded(out, [c for c in out.columns if not c.endswith("points")], 6)


_LINES = "lines AS (SELECT *, l_returnflag = 'R' AS returned, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)"


def _rank(value: str, over: str = "") -> str:
    part = f"PARTITION BY {over} " if over else ""
    tie = f"PARTITION BY {over + ', ' if over else ''}{value}"
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0)"


_QS = ((0.001, "p0_1"), (0.01, "p1"), (0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))
_NEAR = "CAST(l_extendedprice / 100000.0 AS DOUBLE)"


def _partial(keys: str) -> str:
    """Residuals of ranks on 1, z, z^2 by the normal equations' closed form."""
    return f"""
rk AS (SELECT {keys} AS g, {_rank('x', keys)} AS a, {_rank('y', keys)} AS b, {_rank('r', keys)} AS r FROM src),
ms AS (SELECT g, avg(a) AS ma, avg(b) AS mb, avg(r) AS mr, stddev_pop(r) AS s, count(*) AS n FROM rk GROUP BY g),
ct AS (SELECT rk.g, n, (r - mr) / greatest(s, 1e-12) AS z, a - ma AS a, b - mb AS b FROM rk JOIN ms ON rk.g = ms.g),
mo AS (SELECT g, max(n) AS n, avg(z*z) AS z2, avg(z*z*z) AS z3, avg(z*z*z*z) AS z4, avg(a*z) AS az, avg(b*z) AS bz, avg(a*z*z) AS az2, avg(b*z*z) AS bz2, avg(a*a) AS aa, avg(b*b) AS bb, avg(a*b) AS ab FROM ct GROUP BY g),
no AS (SELECT *, z4 - z2*z2 - z3*z3/z2 AS w, az2 - z3/z2*az AS ap, bz2 - z3/z2*bz AS bp FROM mo),
pr AS (SELECT g, n, (ab - az*bz/z2 - ap*bp/w) / sqrt((aa - az*az/z2 - ap*ap/w) * (bb - bz*bz/z2 - bp*bp/w)) AS p FROM no)"""


SQL = {
    "describe": "SELECT event_type, count(value) AS count, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in _QS)
    + " FROM events GROUP BY event_type",
    "describe_all": "SELECT count(*) AS count, round(min(p), 3) AS min, round(avg(p), 3) AS mean, round(stddev_pop(p), 3) AS std, round(max(p), 3) AS max, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 3) AS iqr, round(quantile_cont(p, 0.05), 3) AS p5, round(quantile_cont(p, 0.5), 3) AS p50, round(quantile_cont(p, 0.95), 3) AS p95 FROM (SELECT l_extendedprice AS p FROM lineitem)",
    "average_ranks": f"SELECT l_orderkey, l_linenumber, {_rank('l_quantity', 'l_returnflag')} AS avg_rank FROM lineitem",
    "percentile_ranks": f"SELECT event_id, round(2 * {_rank('value', 'user_id')} / count(*) OVER (PARTITION BY user_id) - 1, 9) AS percentile FROM events",
    "pearson": "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS corr FROM lineitem GROUP BY l_returnflag",
    "spearman": f"SELECT l_returnflag, count(*) AS n, round(corr(a, b), 9) AS spearman FROM (SELECT l_returnflag, {_rank('l_quantity', 'l_returnflag')} AS a, {_rank('l_extendedprice', 'l_returnflag')} AS b FROM lineitem) GROUP BY l_returnflag",
    "partial_spearman": f"WITH src AS (SELECT l_returnflag, l_extendedprice AS x, l_discount AS y, l_quantity AS r FROM lineitem), {_partial('l_returnflag')} SELECT g AS l_returnflag, n, round(p, 7) AS partial_spearman FROM pr",
    "auc": f"""
WITH d AS (SELECT lang, n_chars, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, good, {_rank('n_chars', 'lang')} AS r FROM d),
s AS (SELECT lang, count(*) FILTER (WHERE good) AS p, count(*) FILTER (WHERE NOT good) AS n, sum(CASE WHEN good THEN r END) AS s FROM r GROUP BY lang)
SELECT lang, p AS n_positive, n AS n_negative, CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2.0) / (p * n), 9) END AS auc FROM s""",
    "ks": f"""
WITH {_LINES}, v AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE returned) AS a, count(*) FILTER (WHERE NOT returned) AS b FROM lines GROUP BY 1),
c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v WINDOW w AS (ORDER BY v)) SELECT round(max(abs(ca / na - cb / nb)), 9) AS ks FROM c""",
    "wasserstein": """
WITH g AS (SELECT list_transform(range(0, 2001), lambda i: i / 2000.0) AS q),
s AS (SELECT event_type = 'purchase' AS side, list(value ORDER BY value) AS v, count(*) - 1 AS n FROM events GROUP BY 1),
p AS (SELECT side, i, v, n, i * n / CAST(2000 AS DOUBLE) AS pos FROM s, range(0, 2001) AS r(i)),
x AS (SELECT side, i, v[CAST(floor(pos) AS BIGINT) + 1] AS lo, v[CAST(ceil(pos) AS BIGINT) + 1] AS hi, pos - floor(pos) AS f FROM p),
y AS (SELECT i, max(CASE WHEN side THEN lo + (hi - lo) * f END) AS a, max(CASE WHEN NOT side THEN lo + (hi - lo) * f END) AS b FROM x GROUP BY i)
SELECT round(avg(abs(a - b)), 6) AS wasserstein FROM y""",
    "quantile_gap": f"""
WITH {_LINES}, q AS (SELECT returned, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, unnest(quantile_cont(l_extendedprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v FROM lines GROUP BY returned),
w AS (SELECT q, max(CASE WHEN returned THEN v END) AS r, max(CASE WHEN NOT returned THEN v END) AS t FROM q GROUP BY q)
SELECT round(avg(abs(t - r)) / greatest(max(CASE WHEN q = 0.75 THEN r END) - max(CASE WHEN q = 0.25 THEN r END), 0.05), 9) AS quantile_gap FROM w""",
    "quantisation": """
WITH x AS (SELECT l_returnflag, CAST(l_discount AS DOUBLE) AS x FROM lineitem), l AS (SELECT l_returnflag, round(x, 6) AS v, count(*) AS c FROM x GROUP BY ALL),
s AS (SELECT *, v - lag(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS d, c / sum(c) OVER (PARTITION BY l_returnflag) AS p FROM l),
a AS (SELECT l_returnflag, count(*) AS unique_values, sum(-p * log2(p)) AS h, min(CASE WHEN d > 1e-9 THEN d END) AS mi, quantile_cont(CASE WHEN d > 1e-9 THEN d END, 0.5) AS me FROM s GROUP BY l_returnflag),
b AS (SELECT l_returnflag, count(*) AS samples, avg(CAST(abs(x) <= 1e-8 AS INT)) AS z, avg(CAST(x < 0 AS INT)) AS n, avg(CAST(x > 0 AS INT)) AS p, min(x) AS minimum, max(x) AS maximum FROM x GROUP BY l_returnflag)
SELECT l_returnflag, samples, round(z, 7) AS zero_fraction, round(n, 7) AS negative_fraction, round(p, 7) AS positive_fraction, minimum, maximum, unique_values, round(h, 7) AS entropy_bits, round(mi, 7) AS min_step,
       round(me, 7) AS median_step, round(unique_values / samples, 7) AS unique_fraction, round(pow(2, h), 7) AS effective_levels FROM a JOIN b USING (l_returnflag)""",
    "deciles": f"""
WITH s AS (SELECT {_rank('l_quantity', 'l_returnflag')} / count(*) OVER (PARTITION BY l_returnflag) AS p, {_NEAR} AS d FROM lineitem),
t AS (SELECT 1 + len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 3/10.0::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 6/10.0::DOUBLE, 7/10.0::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda e: p > e)) AS decile, d FROM s)
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS points, round(avg(CAST(d <= 0.1 AS INT)), 5) AS within_10, round(avg(CAST(d <= 0.2 AS INT)), 5) AS within_near, round(avg(CAST(d <= 0.3::DOUBLE AS INT)), 5) AS within_30,
       round(quantile_cont(d, 0.25), 5) AS p25, round(quantile_cont(d, 0.5), 5) AS median, round(quantile_cont(d, 0.75), 5) AS p75 FROM t GROUP BY 1""",
    "range_bins": f"""
WITH {_LINES}, b AS (SELECT CASE WHEN q < 10 THEN 0 WHEN q < 20 THEN 1 WHEN q < 35 THEN 2 ELSE 3 END AS bin, l_extendedprice AS x, returned FROM lines WHERE q >= 1 AND q < 50),
r AS (SELECT bin, returned, {_rank('x', 'bin')} AS a, {_rank('returned', 'bin')} AS y FROM b),
s AS (SELECT bin, count(*) AS points, corr(a, y) AS s, count(*) FILTER (WHERE returned) AS p, count(*) FILTER (WHERE NOT returned) AS n, sum(CASE WHEN returned THEN a END) AS t FROM r GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, points, round(s, 7) AS spearman, round((t - p * (p + 1) / 2.0) / (p * n), 7) AS auc FROM s WHERE points >= 50""",
    "minmax": "SELECT event_id, round(1 - CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END, 9) AS scaled FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type))",
    "robust_scale": """
WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY user_id)
SELECT event_id, round(greatest(-5.0, least(5.0, (value - m) / greatest(b - a, 1e-6))) / 5.0, 7) AS robust FROM events JOIN q USING (user_id)""",
    "support_overlap": f"""
WITH {_LINES}, q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lines WHERE returned)
SELECT count(*) AS n, round(avg(CAST(l_extendedprice < lo AS INT)), 9) AS below, round(avg(CAST(l_extendedprice > hi AS INT)), 9) AS above, round(avg(CAST(l_extendedprice BETWEEN lo AND hi AS INT)), 9) AS within FROM lines, q WHERE NOT returned""",
    "proximity_summary": f"""
WITH src AS (SELECT 1 AS g1, l_discount AS x, -{_NEAR} AS y, l_quantity AS r, {_NEAR} AS d FROM lineitem), {_partial('g1')},
sp AS (SELECT corr(a, b) AS s FROM rk),
cl AS (SELECT d <= 0.2 AS near, {_rank('x')} AS r FROM src WHERE d <= 0.2 OR d > 0.4),
au AS (SELECT count(*) FILTER (WHERE near) AS p, count(*) FILTER (WHERE NOT near) AS n, sum(CASE WHEN near THEN r END) AS s FROM cl),
qu AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM src),
en AS (SELECT quantile_cont(CASE WHEN x <= a THEN d END, 0.5) AS mb, quantile_cont(CASE WHEN x >= b THEN d END, 0.5) AS mt, avg(CASE WHEN x <= a THEN CAST(d <= 0.2 AS INT) END) AS fb, avg(CASE WHEN x >= b THEN CAST(d <= 0.2 AS INT) END) AS ft FROM src, qu)
SELECT (SELECT count(*) FROM src) AS points, (SELECT count(*) FROM src WHERE d <= 0.2) AS near_points, (SELECT count(*) FROM src WHERE d > 0.4) AS clutter_points, round(sp.s, 6) AS spearman, round(pr.p, 6) AS partial_spearman,
       round((au.s - au.p * (au.p + 1) / 2.0) / (au.p * au.n), 6) AS auc, round(mb, 6) AS median_distance_bottom_quartile, round(mt, 6) AS median_distance_top_quartile, round(fb, 6) AS near_fraction_bottom_quartile, round(ft, 6) AS near_fraction_top_quartile
FROM sp, pr, au, en""",
}

QUERIES = {f.__name__: f for f in (
    describe, describe_all, average_ranks, percentile_ranks, pearson, spearman, partial_spearman, auc, ks, wasserstein, quantile_gap, quantisation, deciles, range_bins, minmax, robust_scale, support_overlap, proximity_summary,
)}
