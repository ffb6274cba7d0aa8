"""Top-k nearest-time join: for each source sample the k target samples nearest in time.

A join on positions. Targets of a group are numbered in time order; each source finds
how many targets lie before it; its candidates are a fixed number of positions on
either side, an equi-join. Counts over long runs are scanned in slices of time, so no
task needs to hold a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.scan import SLICE, scan
from chronoweave.operators.statistics import percentiles

#: Support states that no target stands behind.
UNSUPPORTED = ("outside_run", "missing_source_time", "missing_target")


@dataclass(frozen=True)
class NearestConfig:
    """Policies of a nearest mapping; names may be written with hyphens."""

    top_k: int = 3
    weak_ms: float = 75.0
    max_ms: float = 200.0
    extrapolation_policy: str = "disallow"
    source_window_policy: str = "target_overlap"
    source_margin_ms: float = 0.0
    primary_policy: str = "supported_only"
    allow_numeric_identity: bool = False

    def __post_init__(self):
        for field, allowed in (("source_window_policy", ("target_overlap", "all")), ("primary_policy", ("supported_only", "within_max_delta", "nearest_any"))):
            value = str(getattr(self, field) or allowed[0]).replace("-", "_")
            if value not in allowed:
                raise ValueError(f"unknown {field} {value!r}: one of {', '.join(allowed)}")
            object.__setattr__(self, field, value)


def nearest_targets(sources: DataFrame, targets: DataFrame, keys: list[str], k: int = 3, slice_width: int = SLICE, more: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest targets of every source of the same group.

    sources, targets: keys, sample_index, t (long, microseconds; null times take no part).
    Returns keys, source_sample_index, source_t, target_sample_index, target_t, rank,
    delta_us (target minus source), t_min, t_max (the group's target coverage), and the
    columns `more` of the sources. Ties in distance go to the earlier target, equal times
    to the smaller sample_index. A group with fewer targets gives fewer rows; k below 1
    counts as 1.
    """
    take = max(1, k)
    src = sources.where("t is not null").select(*keys, "sample_index", "t", F.lit(False).alias("is_target"), F.struct(F.lit(0).alias("_"), *more).alias("_more"))
    tgt = targets.where("t is not null").select(*keys, "sample_index", "t", F.lit(True).alias("is_target"))
    # at one time sources come before targets, so they count strictly earlier ones
    target = F.col("is_target").cast("long")
    time = F.when(F.col("is_target"), F.col("t"))
    both = scan(
        src.unionByName(tgt, allowMissingColumns=True), keys, F.floor(F.col("t") / slice_width), ["t", "is_target", "sample_index"],
        sums={"pos": target}, wholes={"n": (F.sum, target), "t_min": (F.min, time), "t_max": (F.max, time)}, of=[src, tgt],
    )
    numbered = both.where("is_target").select(*keys, (F.col("pos") - 1).alias("_p"), F.col("sample_index").alias("target_sample_index"), F.col("t").alias("target_t"))
    low, high = F.greatest(F.col("pos") - (take + 2), F.lit(0)), F.least(F.col("pos") + (take + 2), F.col("n") - 1)
    wanted = both.where("not is_target and n > 0").select(*keys, F.col("sample_index").alias("source_sample_index"), F.col("t").alias("source_t"), "t_min", "t_max", "_more", F.explode(F.sequence(low, high)).alias("_p"))
    met = wanted.join(numbered, [*keys, "_p"]).withColumn("delta_us", F.col("target_t") - F.col("source_t"))
    order = W.partitionBy(*keys, "source_sample_index", "source_t").orderBy(F.abs("delta_us"), "_p")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
    return best.select(*keys, "source_sample_index", "source_t", "target_sample_index", "target_t", "rank", "delta_us", "t_min", "t_max", *[F.col(f"_more.{c}").alias(c) for c in more])


def in_window(config: NearestConfig) -> Column:
    """Whether a source lies in the targets' time, by the window policy."""
    if config.source_window_policy == "all":
        return F.lit(True)
    margin = F.lit(max(config.source_margin_ms, 0.0) * 1000)
    return F.col("source_t").between(F.col("t_min") - margin, F.col("t_max") + margin)


def primary(support: Column, rank: Column, delta_ms: Column, config: NearestConfig) -> Column:
    if config.primary_policy == "supported_only":
        ok = support == "supported"
    else:
        ok = ~support.isin(*UNSUPPORTED)
        if config.primary_policy == "within_max_delta":
            ok = ok & (F.abs(delta_ms) <= config.max_ms)
    return (rank == 1) & ok


def label_nearest(matched: DataFrame, config: NearestConfig) -> DataFrame:
    """Adds delta_ms, mapping_region_type, support_status, is_primary and confidence_score."""
    delta = F.col("delta_us") / 1000.0
    region = F.when(F.col("source_t") < F.col("t_min"), "left_extrapolation").when(F.col("source_t") > F.col("t_max"), "right_extrapolation").otherwise("interpolation")
    beyond = "outside_run" if config.extrapolation_policy == "disallow" else "extrapolated"
    out = matched.withColumns({"delta_ms": delta, "mapping_region_type": region})
    support = F.when(F.col("mapping_region_type") != "interpolation", beyond).when(F.abs("delta_ms") > config.weak_ms, "weak_support").otherwise("supported")
    out = out.withColumn("support_status", support)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs("delta_ms") / config.max_ms)) if config.max_ms > 0 else F.lit(0.0)
    return out.withColumns({
        "is_primary": primary(F.col("support_status"), F.col("rank"), F.col("delta_ms"), config),
        "confidence_score": F.when(F.col("support_status").isin(*UNSUPPORTED), 0.0).otherwise(near),
    })


def nearest_mapping(sources: DataFrame, targets: DataFrame, keys: list[str], config: NearestConfig = NearestConfig(), slice_width: int = SLICE) -> DataFrame:
    """nearest_targets inside the source window, with all labels."""
    matched = nearest_targets(sources, targets, keys, config.top_k, slice_width)
    return label_nearest(matched.where(in_window(config)), config)


def mapping_diagnostics(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, metric, value) of a labelled mapping's counts and primary delta quantiles."""
    main = F.when(F.col("is_primary"), F.abs("delta_ms"))
    wide = mapping.groupBy(keys).agg(
        F.count("*").cast("double").alias("sample_mapping_rows"),
        F.count_if("is_primary").cast("double").alias("primary_rows"),
        F.countDistinct("source_sample_index").cast("double").alias("mapped_sources"),
        F.countDistinct(F.when(F.col("is_primary"), F.col("target_sample_index"))).cast("double").alias("primary_targets"),
        F.max(main).alias("primary_abs_delta_ms_max"),
    )
    q = percentiles(mapping, keys, {"primary_abs_delta_ms_median": (main, 0.5), "primary_abs_delta_ms_p95": (main, 0.95)})
    wide = wide.join(q, keys) if keys else wide.join(F.broadcast(q))  # without keys: one row
    metrics = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, metrics, "metric", "value").where("value is not null")
    states = mapping.groupBy(*keys, "support_status").agg(F.count("*").cast("double").alias("value"))
    return long.unionByName(states.select(*keys, F.concat(F.lit("support_status:"), F.col("support_status")).alias("metric"), "value"))
