"""Sample numbering, fitted timelines, coverage and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.scan import numbered, slice_of


def sample_index(rows: DataFrame, run: list[str], order: list[str], name: str = "sample_index", slice_width: int | None = None) -> DataFrame:
    """rows numbered from 0 inside each run; a long run is cut into slices of its first order column."""
    return numbered(rows, run, slice_of(rows, order[0], slice_width), order, name)


def fit_lines(rows: DataFrame, run: list[str], x: str, y_us: str) -> DataFrame:
    """Least squares line of y (microseconds) over x for each run.

    Columns: run, origin_us, slope (seconds per x), intercept_sec (after the origin), n,
    rmse_ms. Time is rebased to the run's first value, so no digits are lost at epoch
    scale. Runs with fewer than two points or one distinct x have no row.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y_us).isNotNull()).select(*run, F.col(x).cast("double").alias("x"), F.col(y_us).alias("y"))
    origin = pairs.groupBy(run).agg(F.min("y").alias("origin_us"), F.min("x").alias("x0"))
    based = pairs.join(origin, run).withColumn("s", (F.col("y") - F.col("origin_us")) / 1e6)
    xs, ys = F.col("x"), F.col("s")
    fit = based.groupBy(*run, "origin_us").agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept_sec"),
        F.count("*").alias("n"),
        F.min("x").alias("_low"),
        F.max("x").alias("_high"),
        F.regr_syy(ys, xs).alias("_syy"),
        F.regr_sxy(ys, xs).alias("_sxy"),
    )
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    return fit.where("n >= 2 and _high > _low").withColumn("rmse_ms", F.sqrt(rest / F.col("n")) * 1000).drop("_low", "_high", "_syy", "_sxy")


def fitted_times(rows: DataFrame, fits: DataFrame, run: list[str], x: str, y_us: str) -> DataFrame:
    """rows with fitted_us (rounded half-even to microseconds) and residual_ms where y was observed."""
    seconds = F.col("slope") * F.col(x) + F.col("intercept_sec")
    out = rows.join(fits.select(*run, "origin_us", "slope", "intercept_sec"), run)
    return out.withColumns({
        "fitted_us": F.col("origin_us") + F.bround(seconds * 1e6).cast("long"),
        "residual_ms": ((F.col(y_us) - F.col("origin_us")) / 1e6 - seconds) * 1000,
    }).drop("origin_us", "slope", "intercept_sec")


def fit_report(fits: DataFrame, run: list[str]) -> DataFrame:
    """Long form (run, metric, value) of fitted lines."""
    wide = fits.select(*run, F.col("n").cast("double").alias("num_fit_points"), F.col("slope").alias("slope_sec"), "intercept_sec", "rmse_ms", F.when(F.col("slope") != 0, 1 / F.col("slope")).alias("fps_est"))
    return wide.unpivot(run, [c for c in wide.columns if c not in run], "metric", "value")


def coverage(times: DataFrame, run: list[str]) -> DataFrame:
    """First and last time and number of samples of each run; runs without a time have no row."""
    return times.where("t is not null").groupBy(run).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count("*").alias("n"))


def overlap_pairs(sources: DataFrame, targets: DataFrame, subject: list[str], run: str = "run_id", min_overlap_sec: float = 5.0) -> DataFrame:
    """All source-run and target-run pairs of a subject with their overlap and what to do with them.

    sources, targets: coverage rows (t in microseconds; null for a run without times).
    """
    side = lambda df, p: df.select(*subject, *[F.col(c).alias(f"{p}_{c}") for c in (run, "t_min", "t_max")])
    pairs = side(sources, "source").join(side(targets, "target"), subject)
    span = (F.least("source_t_max", "target_t_max") - F.greatest("source_t_min", "target_t_min")) / 1e6
    pairs = pairs.withColumn("overlap_sec", F.when(F.col("source_t_min").isNotNull() & F.col("target_t_min").isNotNull(), span))
    status = (
        F.when(F.col("source_t_min").isNull(), "skipped_missing_source_timeline")
        .when(F.col("target_t_min").isNull(), "skipped_missing_target_timeline")
        .when(F.col("overlap_sec") <= 0, "skipped_no_overlap")
        .when(F.col("overlap_sec") < min_overlap_sec, "skipped_below_min_overlap")
        .otherwise("mapped")
    )
    return pairs.withColumn("status", status)


def run_summary(runs: DataFrame, samples: DataFrame, run: list[str]) -> DataFrame:
    """runs with the number of their samples, 0 without any."""
    counts = samples.groupBy(run).agg(F.count("*").alias("num_samples"))
    return runs.join(counts, run, "left").withColumn("num_samples", F.coalesce("num_samples", F.lit(0)))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
