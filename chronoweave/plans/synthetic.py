"""Ten clock cases with known truth: how well piecewise models recover it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.nearest import nearest_targets
from chronoweave.operators.piecewise import fit_segments, predict

#: Case, truth over source seconds s, source seconds, anchors' source seconds, spans of target times.
CASES = (
    ("identity", lambda s: s, 20, (0, 5, 10, 15, 20), ((0, 20),)),
    ("constant_offset", lambda s: s + 1.25, 20, (0, 5, 10, 15, 20), ((1.25, 21.25),)),
    ("global_affine_drift", lambda s: s * 0.98 + 0.5, 20, (0, 6, 12, 20), ((0.5, 20.1),)),
    ("piecewise_drift", lambda s: F.when(s <= 10, s * 1.02 + 0.2).otherwise((s - 10) * 0.94 + 10.4), 20, (0, 5, 10, 15, 20), ((0.2, 19.8),)),
    ("sparse_anchors", lambda s: s + F.sin(s / 3) * 0.4, 20, (2, 18), ((0, 20),)),
    ("bad_anchor", lambda s: s + 0.75, 20, (0, 5, 10, 15, 20), ((0.75, 20.75),)),
    ("partial_overlap", lambda s: s - 2.0, 24, (4, 10, 16, 22), ((2, 18),)),
    ("before_after_anchor_extrapolation", lambda s: s * 1.05 - 0.5, 20, (5, 10, 15), ((-0.5, 20.5),)),
    ("target_gap_or_dropped_segment", lambda s: s + 0.3, 20, (0, 5, 12, 20), ((0.3, 8), (10, 20.3))),
    ("different_frame_rates_15fps_vs_20fps", lambda s: s * 1.01 + 0.1, 20, (0, 7, 14, 20), ((0.1, 20.3),)),
)
SOURCE_FPS, TARGET_FPS = 15, 20


def _truth(s: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, truth, *_ in CASES:
        out = F.when(F.col("case") == name, truth(s)).otherwise(out)
    return out


def frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, targets (case, sample_index, t in seconds) and anchors of all cases."""
    spans = spark.createDataFrame([(n, float(sec)) for n, _, sec, *_ in CASES], "case string, sec double")
    sources = spans.select("case", F.posexplode(F.sequence(F.lit(0), F.round(F.col("sec") * SOURCE_FPS).cast("int"))).alias("sample_index", "k")).select("case", F.col("sample_index").cast("long").alias("sample_index"), (F.col("k") / SOURCE_FPS).alias("t"))
    rows = [(n, i, float(a), float(b)) for n, *_, spans_ in CASES for i, (a, b) in enumerate(spans_)]
    grid = spark.createDataFrame(rows, "case string, part int, a double, b double").select("case", "part", "a", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) * TARGET_FPS + 1e-6).cast("int"))).alias("k"))
    from chronoweave.operators.timelines import sample_index

    targets = sample_index(grid.select("case", "part", "k", (F.col("a") + F.col("k") / TARGET_FPS).alias("t")), ["case"], ["part", "k"]).select("case", "sample_index", "t")
    marks = spark.createDataFrame([(n, f"a{i}", float(s)) for n, _, _, at, _ in CASES for i, s in enumerate(at)], "case string, anchor_id string, source_time double")
    wrong = F.when((F.col("case") == "bad_anchor") & (F.col("anchor_id") == "a2"), 1.2).otherwise(0.0)
    return sources, targets, marks.withColumn("target_time", _truth(F.col("source_time")) + wrong)


def report(spark: SparkSession) -> DataFrame:
    """case, median and largest error of the predicted times and of the nearest targets, in ms."""
    sources, targets, anchors = frames(spark)
    times = sources.select("case", "sample_index", F.col("t").alias("source_time"))
    found = predict(times, fit_segments(anchors, ["case"]), ["case"], "allow_linear")
    found = found.withColumn("truth", _truth(F.col("source_time"))).withColumn("error_ms", F.abs(F.col("target_time") - F.col("truth")) * 1000)
    us = lambda df, t: df.select("case", "sample_index", F.bround(F.col(t) * 1e6).cast("long").alias("t"))
    near = nearest_targets(us(found, "target_time"), us(targets, "t"), ["case"], 1).select("case", F.col("source_sample_index").alias("sample_index"), (F.col("target_t") / 1e6).alias("chosen"))
    both = found.join(near, ["case", "sample_index"], "left").withColumn("nearest_ms", F.abs(F.col("chosen") - F.col("truth")) * 1000)
    half = lambda c: F.percentile(c, F.lit(0.5))
    return both.groupBy("case").agg(F.count("*").alias("samples"), half("error_ms").alias("median_error_ms"), F.max("error_ms").alias("max_error_ms"), half("nearest_ms").alias("median_nearest_ms"), F.max("nearest_ms").alias("max_nearest_ms"))
