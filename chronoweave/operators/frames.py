"""Windows of frames, segments, splits and samples of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.scan import scan, slice_of

#: A draw counts rows in so many bits of their hash.
SLICE_BITS = 12


def index_window(frames: DataFrame, run: list[str], radius: int, payload: str, index: str = "sample_index", name: str = "window") -> DataFrame:
    """Each frame with the rows of all frames within radius indices, in order; missing frames add nothing."""
    around = W.partitionBy(run).orderBy(index).rangeBetween(-radius, radius)
    return frames.withColumn(name, F.flatten(F.collect_list(payload).over(around)))


def index_range(frames: DataFrame, first: int, last: int, payload: str, run: list[str], index: str = "sample_index") -> DataFrame:
    """Rows of the frames first to last of each run, in order; a reversed range is empty."""
    inside = frames.where(F.col(index).between(first, last))
    ordered = F.array_sort(F.collect_list(F.struct(index, payload)))
    return inside.groupBy(run).agg(F.flatten(F.transform(ordered, lambda s: s[payload])).alias(payload))


def strided_windows(centres: DataFrame, frames: DataFrame, run: list[str], width: int, payload: str, centre: str = "target_sample_index", stride: str = "stride", index: str = "sample_index") -> DataFrame:
    """centres with `frames` (array of relative_time, points; null points where missing) and `n_frames`.

    A window has width frames (odd) at the row's stride. An equi-join on the exploded
    indices; windows are width rows each.
    """
    if width < 1 or width % 2 == 0:
        raise ValueError("window width must be odd and positive")
    half = width // 2
    key = [*run, centre, stride]
    spread = centres.select(key).distinct().withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("_i", F.col(centre) + F.col("_o") * F.col(stride))
    met = spread.join(frames.select(*run, F.col(index).alias("_i"), F.col(payload).alias("_p"), F.lit(True).alias("_have")), [*run, "_i"], "left")
    relative = F.col("_o") / float(half) if half else F.lit(0.0)
    each = F.struct(F.col("_o").alias("offset"), relative.alias("relative_time"), F.col("_i").alias("index"), F.col("_p").alias("points"))
    windows = met.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("frames"), F.count("_have").alias("n_frames"))
    return centres.join(windows, key)


def window_support(windows: DataFrame, valid) -> DataFrame:
    """Adds centre_points, window_points and valid_frames, counted by valid, a function of an array of points."""
    counts = F.transform("frames", lambda f: F.coalesce(valid(f["points"]), F.lit(0)))
    out = windows.withColumn("_c", counts)
    return out.withColumns({
        "centre_points": F.element_at("_c", (F.floor(F.size("_c") / 2) + 1).cast("int")),
        "window_points": F.aggregate("_c", F.lit(0), lambda a, b: a + b),
        "valid_frames": F.size(F.filter("_c", lambda c: c > 0)),
    }).drop("_c")


def window_status(windows: DataFrame, width: int, least_centre: int = 1, least_window: int = 1, least_frames: int = 1, pose: str | None = None) -> DataFrame:
    """Adds `status`: ok, or the first reason to skip a window.

    pose: a boolean column pair's stem, `<pose>_found` and `<pose>_valid`; leave it out
    where a missing pose must keep the window.
    """
    status = (
        F.when(F.col("n_frames") < width, "incomplete_radar_window")
        .when(F.col("centre_points") < least_centre, "too_few_center_points")
        .when(F.col("window_points") < least_window, "too_few_window_points")
        .when(F.col("valid_frames") < least_frames, "too_few_valid_window_frames")
    )
    if pose:
        status = status.when(~F.coalesce(f"{pose}_found", F.lit(False)), "missing_pose_payload").when(~F.coalesce(f"{pose}_valid", F.lit(False)), "invalid_pose")
    return windows.withColumn("status", status.otherwise("ok"))


def frame_stride(period_sec: float, fps: str = "target_fps"):
    """Frames between window positions: period times fps, half-even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(period_sec) * F.col(fps)).cast("int"))


def change_segments(rows: DataFrame, run: list[str], order: str, state: str) -> DataFrame:
    """Half-open segments [start, stop) of equal state in each run; null is a state."""
    slices = slice_of(rows, order)
    marked = scan(rows, run, slices, [order], previous={"_before": F.struct(F.col(state).alias("state"))})
    moved = F.col("_before").isNull() | ~F.col(state).eqNullSafe(F.col("_before.state"))
    marked = scan(marked.withColumn("_new", moved), run, slices, [order], sums={"segment_index": F.col("_new").cast("long")}, of=[rows]).withColumn("segment_index", F.col("segment_index") - 1)
    group = marked.groupBy(*run, "segment_index").agg(F.first(state).alias(state), F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count("*").alias("n"))
    return group


def valid_centres(segments: DataFrame, run: list[str], width: int) -> DataFrame:
    """Indices that a whole window of width frames fits around inside one segment."""
    half = width // 2
    return segments.where(F.col("stop") - F.col("start") >= width).select(*run, "segment_index", F.explode(F.sequence(F.col("start") + half, F.col("stop") - half - 1)).alias("centre"))


def sliding_support(rows: DataFrame, run: list[str], order: str, flag: str, width: int) -> DataFrame:
    """Adds the number of flagged rows in the centred window of width rows."""
    half = width // 2
    return rows.withColumn("support", F.sum(F.col(flag).cast("int")).over(W.partitionBy(run).orderBy(order).rowsBetween(-half, half)))


def temporal_split(rows: DataFrame, keys: list[str], order: list[str], fraction: float, start: str, end: str) -> DataFrame:
    """Adds `part`: validation for the last fraction of each group, training for rows whose window
    ends before the first validation window starts, gap for the rest.
    """
    if not 0 < fraction < 0.5:
        raise ValueError("fraction must lie between 0 and 0.5")
    n = F.count("*").over(W.partitionBy(keys))
    take = F.least(F.greatest(F.bround(n * fraction), F.lit(1)), n - 2)
    out = rows.withColumn("_held", F.row_number().over(W.partitionBy(keys).orderBy(*[F.desc(c) for c in order])) <= take)
    begin = F.min(F.when(F.col("_held"), F.col(start))).over(W.partitionBy(keys))
    return out.withColumn("_begin", begin).withColumn("part", F.when(F.col("_held"), "validation").when(F.col(end) < F.col("_begin"), "training").otherwise("gap")).drop("_held", "_begin")


def calibration_split(rows: DataFrame, keys: list[str], order: list[str], fraction: float) -> DataFrame:
    """Adds `part`: the first rows calibrate, the rest evaluate."""
    placed = scan(rows, keys, slice_of(rows, order[0]), order, sums={"_i": F.lit(1)}, wholes={"_n": (F.sum, F.lit(1))})
    n = F.col("_n")
    many = F.least(F.greatest(F.lit(10), F.bround(n * fraction)), n - 1)
    take = F.when(n >= 11, many).otherwise(F.greatest(F.lit(1), n - 1))
    return placed.withColumn("part", F.when(F.col("_i") <= take, "calibration").otherwise("evaluation")).drop("_i", "_n")


def _drawn(seed: int, columns: list[str]):
    """A reproducible random order: a hash of the row's identity."""
    return F.xxhash64(F.lit(seed), *columns)


def evenly(i: Column, n: Column, maximum: int) -> Column:
    """Whether place i of n (from 0) is among `maximum` evenly spaced ones; all are, if maximum is 0 or less or n no larger."""
    if maximum <= 0:
        return F.lit(True)
    # place i is taken if it is the whole part of j (n - 1) / (m - 1) for some j
    step = (n - 1) / F.lit(float(max(maximum - 1, 1)))
    j = F.ceil(i / F.greatest(step, F.lit(1e-12)) - 1e-9)
    hit = (F.floor(j * step + 1e-9) == i) & (j <= maximum - 1) if maximum > 1 else i == 0
    return (n <= maximum) | hit


def even_subsample(rows: DataFrame, keys: list[str], order: list[str], maximum: int) -> DataFrame:
    """At most maximum rows of each group, evenly spaced; all of them if maximum is 0 or less."""
    if maximum <= 0:
        return rows
    placed = scan(rows, keys, slice_of(rows, order[0]), order, sums={"_i": F.lit(1)}, wholes={"_n": (F.sum, F.lit(1))})
    return placed.where(evenly(F.col("_i") - 1, F.col("_n"), maximum)).drop("_i", "_n")


def drawn(rows: DataFrame, keys: list[str], identity: list[str], quotas: DataFrame | int, seed: int = 0) -> DataFrame:
    """From each group the rows that come first in a random order, the same for every run: as many as its quota.

    quotas: keys and `quota`, a row a group, or one number for all. The order is that of a
    hash of the rows' identity. Rows are counted in slices of the hash; slices before
    the one in which the quota falls are taken whole, and only that one's rows are put
    in order.
    """
    if isinstance(quotas, int):
        quotas = rows.select(keys).distinct().withColumn("quota", F.lit(quotas)) if keys else rows.sparkSession.range(1).select(F.lit(quotas).alias("quota"))
    same = lambda a, b, names: reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), names, F.lit(True))
    hashed = rows.withColumn("_h", _drawn(seed, identity)).withColumn("_slice", F.shiftright("_h", 64 - SLICE_BITS))
    counts = hashed.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    before = (W.partitionBy(keys) if keys else W.partitionBy(F.lit(0))).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # 2 ** SLICE_BITS rows
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    cut = counts.alias("c").join(quotas.alias("q"), same("c", "q", keys)).select("c.*", (F.col("q.quota") - F.col("_before")).alias("_take")).where("_take > 0")
    met = hashed.alias("r").join(cut.alias("c"), same("r", "c", [*keys, "_slice"])).select("r.*", "_c", "_take")
    whole = met.where("_take >= _c").select(rows.columns)
    order = W.partitionBy(*keys, "_slice").orderBy("_h", *identity)
    part = met.where("_take < _c").withColumn("_r", F.row_number().over(order)).where("_r <= _take").select(rows.columns)
    return whole.unionByName(part)


def random_cap(rows: DataFrame, identity: list[str], maximum: int, seed: int = 0) -> DataFrame:
    """A random subset of at most maximum rows, the same for every run."""
    return drawn(rows, [], identity, maximum, seed) if maximum > 0 else rows


def stratified_cap(rows: DataFrame, strata: list[str], identity: list[str], maximum: int, seed: int = 0) -> DataFrame:
    """Each stratum keeps its share of maximum rows, at least one, at random."""
    sizes = rows.groupBy(strata).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    quotas = sizes.join(F.broadcast(total)).select(*strata, F.greatest(F.lit(1), F.bround(maximum * F.col("_n") / F.col("_total"))).alias("quota"))  # one row
    return drawn(rows, strata, identity, quotas, seed)


def balanced_reservoir(points: DataFrame, frame: list[str], identity: list[str], maximum: int, seed: int = 0) -> DataFrame:
    """At most ceil(maximum / frames) random rows of each frame, then at most maximum of all."""
    frames = points.select(frame).distinct()
    per = frames.agg(F.greatest(F.lit(1), F.ceil(F.lit(maximum) / F.count("*"))).alias("quota"))
    return random_cap(drawn(points, frame, identity, frames.join(F.broadcast(per)), seed), identity, maximum, seed + 1)  # one row


def matched_sample(rows: DataFrame, bins: list[str], side: str, identity: list[str], seed: int = 0) -> DataFrame:
    """From each bin the same number of rows of both sides: the smaller side's count, at random."""
    counts = rows.groupBy(bins).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b"))
    quotas = counts.select(*bins, F.explode(F.array(F.lit(True), F.lit(False))).alias(side), F.least("_a", "_b").alias("quota"))
    return drawn(rows, [*bins, side], identity, quotas, seed)


def subject_split(rows: DataFrame, subject: str, test: float = 0.2, validation: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds `part`: whole subjects go to test, validation or training, in a random order."""
    subjects = rows.select(subject).distinct()
    sizes = [F.greatest(F.lit(1), F.bround(F.count("*") * f)) for f in (test, validation)]
    # the first draw is the beginning of the second
    first, both = (drawn(subjects, [], [subject], subjects.agg(q.alias("quota")), seed) for q in (sizes[0], sizes[0] + sizes[1]))
    placed = both.join(first.withColumn("_first", F.lit(True)), subject, "left").select(subject, F.when(F.col("_first"), "test").otherwise("validation").alias("part"))
    return rows.join(placed, subject, "left").withColumn("part", F.coalesce("part", F.lit("training")))


def environment_split(rows: DataFrame, environment: str, test_env: str, val_env: str | None = None) -> DataFrame:
    """Adds `part` by environment; without val_env the last of the others validates."""
    found = [r[0] for r in rows.select(environment).distinct().orderBy(environment).collect()]
    if test_env not in found:
        raise ValueError(f"environment {test_env!r} not found among {found}")
    others = [e for e in found if e != test_env]
    if val_env is None:
        if len(others) < 2:
            raise ValueError("a split by environment needs at least three environments")
        val_env = others[-1]
    if val_env not in others:
        raise ValueError(f"invalid validation environment {val_env!r}: one of {others}")
    e = F.col(environment)
    return rows.withColumn("part", F.when(e == test_env, "test").when(e == val_env, "validation").otherwise("training"))


def lag_sweep(rows: DataFrame, keys: list[str], index: str, error, pred: str, truth: str, maximum: int) -> DataFrame:
    """Mean of error(pred at i, truth at i + shift) for each shift from -maximum to maximum, in metres, as mm.

    An equi-join on the shifted index: gaps stay gaps.
    """
    shifted = rows.select(*keys, F.col(index).alias("_at"), F.col(truth).alias("_truth"))
    spread = rows.select(*keys, index, F.col(pred).alias("_pred"), F.explode(F.sequence(F.lit(-maximum), F.lit(maximum))).alias("shift")).withColumn("_at", F.col(index) + F.col("shift"))
    met = spread.join(shifted, [*keys, "_at"])
    return met.groupBy(*keys, "shift").agg((F.avg(error(F.col("_pred"), F.col("_truth"))) * 1000).alias("error_mm"), F.count("*").alias("frames"))


def best_lag(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The shift of least error of each group; the smaller shift on a tie."""
    return sweep.groupBy(keys).agg(F.min_by(F.struct("shift", "error_mm", "frames"), F.struct("error_mm", "shift")).alias("b")).select(*keys, "b.*")


def frame_quotas(points: int, frames: int) -> list[int]:
    """points shared out over an odd number of frames; what is over goes to the frames nearest the centre."""
    if points < 1:
        raise ValueError("points must be positive")
    if frames < 1 or frames % 2 == 0:
        raise ValueError("frames must be a positive odd number")
    quotas = [points // frames] * frames
    for i in sorted(range(frames), key=lambda i: (abs(i - frames // 2), i))[: points % frames]:
        quotas[i] += 1
    return quotas
