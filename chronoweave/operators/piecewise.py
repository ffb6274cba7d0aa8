"""Piecewise-affine clock models: segments between anchors, prediction, diagnostics.

Anchors: group keys, anchor_id, source_time, target_time (seconds, double).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.times import finite
from chronoweave.operators.nearest import UNSUPPORTED, NearestConfig, nearest_targets, primary
from chronoweave.operators.scan import SLICE, scan
from chronoweave.sources.shared import written

#: Policies that all continue the first or last line.
EXTRAPOLATING = ("allow_linear", "allow_with_penalty", "allow_nearest_only")


_ORDER = ["source_time", "anchor_id"]


def _slice(seconds: str, width: int) -> Column:
    """The slice, of `width` microseconds, of a time in seconds; times that are not finite stand together."""
    return F.coalesce(F.floor(finite(F.col(seconds)) / (width / 1e6)), F.lit(1 << 62))


def anchor_problems(anchors: DataFrame, keys: list[str], require_monotonic_target: bool = True, slice_width: int = SLICE) -> DataFrame:
    """Groups whose anchors make no model: keys, problem."""
    rows = scan(anchors, keys, _slice("source_time", slice_width), _ORDER, previous={"_p": F.struct("source_time", "target_time")})
    rows = rows.withColumns({"ds": F.col("source_time") - F.col("_p.source_time"), "dt": F.col("target_time") - F.col("_p.target_time")})
    bad = rows.groupBy(keys).agg(
        F.count("*").alias("n"),
        F.bool_or(finite(F.col("source_time")).isNull() | finite(F.col("target_time")).isNull()).alias("infinite"),
        F.bool_or(F.col("ds") <= 0).alias("source"),
        F.bool_or(F.col("dt") <= 0).alias("target"),
    )
    problem = (
        F.when(F.col("n") < 2, "at least two anchors are required")
        .when(F.col("infinite"), "anchor times must be finite")
        .when(F.col("source"), "anchor source times must be strictly increasing")
        .when(F.lit(require_monotonic_target) & F.col("target"), "anchor target times must be strictly increasing")
    )
    return bad.select(*keys, problem.alias("problem")).where("problem is not null")


def check_anchors(anchors: DataFrame, keys: list[str], require_monotonic_target: bool = True) -> None:
    if found := anchor_problems(anchors, keys, require_monotonic_target).limit(1).collect():
        raise ValueError(f"{found[0]['problem']}: {found[0].asDict()}")


def fit_segments(anchors: DataFrame, keys: list[str], slice_width: int = SLICE) -> DataFrame:
    """The lines between consecutive anchors, numbered from 0 in source time."""
    rows = scan(anchors, keys, _slice("source_time", slice_width), _ORDER, sums={"_n": F.lit(1)}, previous={"_p": F.struct("anchor_id", "source_time", "target_time")})
    rows = rows.where("_p is not null").select(
        *keys, (F.col("_n") - 2).alias("segment_index"), F.col("_p.anchor_id").alias("left_anchor_id"), F.col("anchor_id").alias("right_anchor_id"),
        F.col("_p.source_time").alias("source_start"), F.col("source_time").alias("source_end"), F.col("_p.target_time").alias("target_start"), F.col("target_time").alias("target_end"),
    )
    slope = (F.col("target_end") - F.col("target_start")) / (F.col("source_end") - F.col("source_start"))
    return rows.withColumn("slope", slope).withColumn("intercept", F.col("target_start") - F.col("slope") * F.col("source_start"))


def predict(times: DataFrame, segments: DataFrame, keys: list[str], policy: str = "disallow", slice_width: int = SLICE) -> DataFrame:
    """times (keys, source_time, more) with target_time, region and segment_index.

    A row's segment is the last one that starts at or before it: segments and times are
    scanned together in time order, hour by hour, so no task holds a group. Outside the anchors
    the first or last line goes on if the policy extrapolates; else the row is
    unsupported and its target_time null, as for times that are not finite.
    """
    at = F.struct(*[F.col(c) for c in ("segment_index", "source_start", "source_end", "target_start", "slope")])
    marks = segments.select(*keys, F.col("source_start").alias("_t"), F.lit(0).alias("_side"), at.alias("_mark"), F.lit(None).cast(_row_type(times)).alias("_row"))
    rows = times.select(*keys, F.col("source_time").cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), F.struct(*times.columns).alias("_row"))
    mark = F.col("_mark")
    both = scan(marks.unionByName(rows), keys, _slice("_t", slice_width), ["_t", "_side"], lasts={"_at": mark}, wholes={"_first": (F.min, mark), "_last": (F.max, mark)}, of=[times, segments]).where("_side = 1")
    t = F.col("_t")
    seg = F.coalesce("_at", "_first")
    both = both.withColumn("_seg", seg)
    outside_left, outside_right = t < F.col("_first.source_start"), t > F.col("_last.source_end")
    known = finite(t).isNotNull() & F.col("_first").isNotNull()
    allowed = policy in EXTRAPOLATING
    region = (
        F.when(~F.coalesce(known, F.lit(False)), "unsupported")
        .when(outside_left, "left_extrapolation" if allowed else "unsupported")
        .when(outside_right, "right_extrapolation" if allowed else "unsupported")
        .otherwise("interpolation")
    )
    value = F.col("_seg.target_start") + F.col("_seg.slope") * (t - F.col("_seg.source_start"))
    both = both.withColumn("region", region)
    supported = F.col("region") != "unsupported"
    return both.select("_row.*", F.when(supported, value).alias("target_time"), "region", F.when(supported, F.col("_seg.segment_index")).alias("segment_index"))


def _row_type(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType


def anchor_residuals(anchors: DataFrame, segments: DataFrame, keys: list[str], slice_width: int = SLICE) -> DataFrame:
    """Prediction at each anchor against its own target time."""
    own = anchors.select(*keys, "anchor_id", "source_time", F.col("target_time").alias("observed_time"))
    out = predict(own, segments, keys, "allow_linear", slice_width)
    return out.withColumn("residual_sec", F.col("target_time") - F.col("observed_time")).withColumn("residual_ms", F.col("residual_sec") * 1000)


def leave_one_out(anchors: DataFrame, keys: list[str], slice_width: int = SLICE) -> DataFrame:
    """Error at each anchor of the model fitted without it.

    Without an inner anchor its neighbours' line holds there; without the first or last
    the line of the two nearest goes on. With two anchors the rest is too few.
    """
    own = F.struct("anchor_id", "source_time", "target_time")
    rows = scan(anchors, keys, _slice("source_time", slice_width), _ORDER, sums={"_n": F.lit(1)}, wholes={"n": (F.sum, F.lit(1))})
    # each anchor goes to the places of its two neighbours on either side
    sent = rows.select(*keys, "n", own.alias("a"), "_n", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("_k")).withColumn("_n", F.col("_n") + F.col("_k"))
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    columns = [at(k, f"a.{name}").alias(f"{c}{k}".replace("-", "_")) for c, name in (("s", "source_time"), ("g", "target_time")) for k in (2, 1, -1, -2)]
    rows = sent.groupBy(*keys, "n", "_n").agg(at(0, "a").alias("a"), *columns).where("a is not null").select(*keys, "n", "a.*", *[f"{c}{k}" for c in "sg" for k in ("2", "1", "_1", "_2")])
    pick = lambda x, inner, first, last: F.when(F.col("s1").isNull(), F.col(x + first)).when(F.col("s_1").isNull(), F.col(x + last)).otherwise(F.col(x + inner))
    s0, s1, g0, g1 = pick("s", "1", "_1", "2"), pick("s", "_1", "_2", "1"), pick("g", "1", "_1", "2"), pick("g", "_1", "_2", "1")
    predicted = g0 + (g1 - g0) / (s1 - s0) * (F.col("source_time") - s0)
    enough = F.col("n") > 2
    return rows.select(
        *keys, "anchor_id", "source_time", "target_time", F.when(enough, predicted).alias("predicted_time"),
        F.when(enough, (predicted - F.col("target_time")) * 1000).alias("error_ms"), F.when(enough, "ok").otherwise("insufficient_training_anchors").alias("status"),
    )


def label_piecewise(matched: DataFrame, config: NearestConfig) -> DataFrame:
    """Support, primary and confidence of model-predicted matches (rules of their own)."""
    support = F.when(F.col("region") == "unsupported", "outside_run").when(F.col("region") != "interpolation", "extrapolated").when(F.abs("delta_ms") > config.weak_ms, "weak_support").otherwise("supported")
    out = matched.withColumn("support_status", support)
    base = F.greatest(F.lit(0.0), 1.0 - F.abs("delta_ms") / max(config.max_ms, 1e-9))
    base = F.when(F.col("support_status").isin("weak_support", "extrapolated"), base * 0.5).otherwise(base)
    return out.withColumns({
        "is_primary": primary(F.col("support_status"), F.col("rank"), F.col("delta_ms"), config),
        "confidence_score": F.when(F.col("support_status").isin(*UNSUPPORTED), 0.0).otherwise(base),
    })


def piecewise_mapping(sources: DataFrame, targets: DataFrame, segments: DataFrame, keys: list[str], config: NearestConfig = NearestConfig(), policy: str = "disallow", slice_width: int = SLICE) -> DataFrame:
    """Nearest targets of the predicted times; rows the model does not support are left out.

    sources, targets: keys, sample_index, t (microseconds).
    """
    times = sources.where("t is not null").select(*keys, "sample_index", (F.col("t") / 1e6).alias("source_time"))
    predicted = predict(times, segments, keys, policy, slice_width).where("target_time is not null")
    predicted = predicted.withColumn("t", F.bround(F.col("target_time") * 1e6).cast("long"))
    predicted = written(predicted, "predicted")  # the scan for neighbours reads it twice
    matched = nearest_targets(predicted, targets, keys, config.top_k, slice_width, more=("region", "segment_index")).withColumn("delta_ms", F.col("delta_us") / 1000.0)
    return label_piecewise(matched, config)
