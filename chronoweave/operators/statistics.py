"""Exact distribution statistics that hold no group in one task.

Everything rests on `distribution`: the distinct finite values of each group with
counts and cumulative counts, scanned in slices. A group is cut at its own sampled
values, so it has as many slices as its distinct values need, wherever they lie. Ranks,
quantiles, ECDF distances and AUROC are read from it. `percentiles` needs no
distribution of all values: a histogram finds the bucket of each order statistic, and
only that bucket's values are put in order. NaN and infinite values are left out throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.times import finite
from chronoweave.operators.scan import few, scan
from chronoweave.sources.shared import written

#: Distinct values of a slice, about: one value in so many, by its hash, is a cut.
SLICE_VALUES = 1 << 18
#: Buckets of a histogram between a group's least and largest value.
BUCKETS = 4096
#: The same where some hundred groups are counted together: their counts fit a task.
GROUP_BUCKETS = 512
#: The quantiles of a description and of a quantile gap.
DESCRIBED = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
GAP = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def _cut(dist: DataFrame, keys: list[str]) -> DataFrame:
    """dist with `_cut`: the number of its group's cuts below v, found by halving."""
    sampled = dist.where(F.pmod(F.xxhash64(*keys, "v"), F.lit(SLICE_VALUES)) == 0)
    cuts = F.broadcast(sampled.groupBy(keys).agg(F.array_sort(F.collect_list("v")).alias("_cuts")))  # 8 bytes for SLICE_VALUES values
    dist = dist.join(cuts, keys, "left") if keys else dist.join(cuts, how="left")
    n = F.coalesce(F.size("_cuts"), F.lit(0))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1.0)).cast("int"))

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(F.col("_cuts"), mid) < F.col("v")
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.cast("int").alias("high")), halve)["low"]
    return dist.withColumn("_cut", F.when(n > 0, found).otherwise(0)).drop("_cuts")


def _values(df: DataFrame, value: str) -> Column:
    """The value as a finite double, -0 as 0; else null."""
    return finite(F.col(value).cast("double")) + F.lit(0.0)


def _counted(tables: list[DataFrame | int]) -> list[int]:
    """Rows of the tables together, counted once for all steps that ask."""
    return [sum(x if isinstance(x, int) else x.count() for x in tables)]


def distribution(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column] | None = None, of: list[DataFrame | int] | None = None) -> DataFrame:
    """keys, v, c, upto (rows with values up to v), n; and for each named weight its sum at v and up to v.

    One row per distinct finite value of a group. of: a table of as many rows, if df
    itself is dear to count.
    """
    weights = weights or {}
    of = _counted(of or [df])
    rows = df.withColumn("v", _values(df, value)).where("v is not null")
    sums = {"c": F.lit(1)} | {k: w.cast("double") for k, w in weights.items()}
    dist = rows.groupBy(*keys, "v").agg(*[F.sum(w).alias(k) for k, w in sums.items()])
    by = None
    if not few(*of):
        # cuts, slices and rows all come from it: it is made once
        dist, by = _cut(written(dist, "distribution"), keys), F.col("_cut")
    out = scan(dist, keys, by, ["v"], sums={"upto": F.col("c")} | {f"{k}_upto": F.col(k) for k in weights}, wholes={"n": (F.sum, F.col("c"))}, of=of)
    return out.select(*keys, "v", *sums, "upto", *[f"{k}_upto" for k in weights], "n")


def average_rank() -> Column:
    """Mean rank of the rows of a distribution's value."""
    return F.col("upto") - F.col("c") + (F.col("c") + 1) / 2.0


def with_ranks(df: DataFrame, keys: list[str], value: str, rank: str = "avg_rank", n: str = "n_ranked", of: list[DataFrame | int] | None = None) -> DataFrame:
    """df with average ranks (ties share the mean) and the number of ranked rows; null where not finite.

    of: a table of as many rows, if df itself is dear to count.
    """
    return _with_each_rank(df, keys, {value: (rank, n)}, of)


def _with_each_rank(df: DataFrame, keys: list[str], ranks: dict[str, tuple[str, str]], of: list[DataFrame | int] | None = None) -> DataFrame:
    """with_ranks of several columns: value, and the names of its rank and of the number of ranked rows.

    Of many rows, each column's distribution is taken from df as it is, not from rows that were joined for another.
    """
    of, rows = _counted(of or [df]), df
    if few(*of):
        group = W.partitionBy(keys) if keys else W.partitionBy(F.lit(0))
        for value, (rank, n) in ranks.items():
            v = _values(df, value)
            upto = F.count(v).over(group.orderBy(v.asc_nulls_last()).rangeBetween(W.unboundedPreceding, 0))
            least = F.rank().over(group.orderBy(v.asc_nulls_last()))
            rows = rows.withColumns({rank: F.when(v.isNotNull(), (least + upto) / 2.0), n: F.when(v.isNotNull(), F.count(v).over(group))})
        return rows
    for value, (rank, n) in ranks.items():
        dist = distribution(df, keys, value, of=of).select(*keys, F.col("v").alias("_v"), average_rank().alias(rank), F.col("n").alias(n))
        rows = rows.withColumn("_v", _values(df, value)).join(dist, [*keys, "_v"], "left").drop("_v")
    return rows


def percentile_ranks(df: DataFrame, keys: list[str], value: str, symmetric: bool = False, name: str = "percentile") -> DataFrame:
    """Average rank over count, in (0, 1], or in [-1, 1] if symmetric."""
    ranked = with_ranks(df, keys, value, "_r", "_n")
    p = F.col("_r") / F.col("_n")
    return ranked.withColumn(name, 2 * p - 1 if symmetric else p).drop("_r", "_n")


def quantiles(dist: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """keys, q, value: linear interpolation between the two order statistics around q."""
    every = F.array(*map(F.lit, qs))
    at = lambda q: q * (F.col("n") - 1)
    low, high = F.col("upto") - F.col("c"), F.col("upto")
    inside = lambda p: (p >= low) & (p < high)
    hits = F.filter(every, lambda q: inside(F.floor(at(q))) | inside(F.ceil(at(q))))
    rows = dist.where(F.size(hits) > 0).withColumn("q", F.explode(hits))
    pos = at(F.col("q"))
    part = pos - F.floor(pos)
    rows = rows.withColumns({"_lo": F.when(inside(F.floor(pos)), F.col("v")), "_hi": F.when(inside(F.ceil(pos)), F.col("v")), "_part": part})
    out = rows.groupBy(*keys, "q").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_part").alias("_part"))
    return out.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def grid_quantiles(dist: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """keys, i, value for the quantiles i / steps, i from 0 to steps."""
    last = F.col("n") - 1
    low, high = F.col("upto") - F.col("c"), F.col("upto")
    # the grid points whose order statistics may lie at this value
    first = F.greatest(F.floor((low - 1) * steps / F.greatest(last, F.lit(1))) - 1, F.lit(0)).cast("int")
    end = F.least(F.ceil(high * steps / F.greatest(last, F.lit(1))) + 1, F.lit(steps)).cast("int")
    rows = dist.withColumn("i", F.explode(F.sequence(first, end)))
    pos = F.col("i") * last / F.lit(float(steps))
    inside = lambda p: (p >= low) & (p < high)
    rows = rows.withColumns({"_lo": F.when(inside(F.floor(pos)), F.col("v")), "_hi": F.when(inside(F.ceil(pos)), F.col("v")), "_part": pos - F.floor(pos)})
    out = rows.where("_lo is not null or _hi is not null").groupBy(*keys, "i").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_part").alias("_part"))
    return out.select(*keys, "i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], of: list[DataFrame | int] | None = None) -> DataFrame:
    """keys and one column for each wanted (value, q): the exact quantile, between two order statistics by linear interpolation.

    Every group of df has a row; null without a finite value. Few rows are aggregated at
    once. Of many, a pass counts each value's bucket between its group's ends, which
    merges in any order; the buckets of the order statistics are known from these
    counts, and only their values go on.
    """
    if few(*(of or [df])):
        return df.groupBy(keys).agg(*[F.percentile(finite(c.cast("double")), F.lit(float(q))).alias(n) for n, (c, q) in wanted.items()])
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.lit(float(q)).alias("q"), (finite(c.cast("double")) + F.lit(0.0)).alias("v")) for n, (c, q) in wanted.items()]))
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], values.alias("_x")).select(*[f"_k{i}" for i in range(len(keys))], "_x.*")
    rows = written(rows, "percentile-values")
    own = [*[f"_k{i}" for i in range(len(keys))], "what", "q"]
    same = lambda a, b: reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), own, F.lit(True))
    there = rows.where("v is not null")
    ends = there.groupBy(own).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("total"))
    # halves, so that the distance of the ends is finite
    share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    bucket = F.when(F.col("high") / 2 > F.col("low") / 2, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    placed = there.alias("a").join(ends.alias("b"), same("a", "b")).select("a.*", "low", "high", "total").withColumn("bucket", bucket)
    counts = placed.groupBy(*own, "total", "bucket").agg(F.count("*").alias("held"))
    order = W.partitionBy(*own).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    at = F.col("q") * (F.col("total") - 1)
    within = lambda p, first, n: (p >= first) & (p < first + n)
    held = counts.where(within(F.floor(at), F.col("before"), F.col("held")) | within(F.ceil(at), F.col("before"), F.col("held"))).drop("total", "held")
    chosen = placed.alias("a").join(held.alias("b"), same("a", "b") & (F.col("a.bucket") == F.col("b.bucket"))).select("a.*", "before")
    chosen = written(chosen, "percentile-buckets")
    dist = distribution(chosen, [*own, "total", "before"], "v", of=of or [df])
    first = F.col("before") + F.col("upto") - F.col("c")
    ends = dist.groupBy(*own, "total").agg(F.max(F.when(within(F.floor(at), first, F.col("c")), F.col("v"))).alias("low"), F.max(F.when(within(F.ceil(at), first, F.col("c")), F.col("v"))).alias("high"))
    found = ends.groupBy(*own[:-2]).agg(*[F.max(F.when(F.col("what") == n, F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at)))).alias(n) for n in wanted])
    groups = df.groupBy(keys).agg(F.lit(1).alias("_one"))
    met = groups.join(found, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True)), "left")
    return met.select(*keys, *wanted)


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: Column) -> DataFrame:
    """keys, q, value: exact quantiles of a few large groups, as quantiles gives them; qs is an array of the keys' own.

    df is read three times, for each group's ends, for the counts of the buckets between
    them and for the values of buckets that hold an order statistic. Only those values are
    shuffled and put in order (all of a group, where outliers crowd it into one bucket). Keys
    are not null; the groups' ends are broadcast.
    """
    rows = df.select(*keys, _values(df, value).alias("v")).where("v is not null")
    ends = rows.groupBy(keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("total"))
    ends = F.broadcast(written(ends, "quantile-ends"))  # a row for each group
    # halves, so that the distance of the ends is finite
    share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    bucket = F.when(F.col("high") / 2 > F.col("low") / 2, F.least(F.floor(share * GROUP_BUCKETS), F.lit(GROUP_BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.join(ends, keys).select(*keys, "v", "total", bucket.alias("bucket"))
    counts = placed.groupBy(*keys, "total", "bucket").agg(F.count("*").alias("held"))
    earlier = W.partitionBy(keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    at = lambda q: q * (F.col("total") - 1)
    inside = lambda p, first, n: (p >= first) & (p < first + n)
    hit = lambda first, n: F.filter(qs, lambda q: inside(F.floor(at(q)), first, n) | inside(F.ceil(at(q)), first, n))
    held = counts.where(F.size(hit(F.col("before"), F.col("held"))) > 0).select(*keys, "bucket", "before")
    held = F.broadcast(written(held, "quantile-buckets"))  # two for each group and quantile at most
    chosen = written(placed.join(held, [*keys, "bucket"]), "quantile-values")
    dist = distribution(chosen, [*keys, "total", "bucket", "before"], "v")
    first = F.col("before") + F.col("upto") - F.col("c")
    found = dist.select(*keys, "total", "v", "c", first.alias("first"), F.explode(hit(first, F.col("c"))).alias("q"))
    pos = at(F.col("q"))
    pick = lambda p: F.max(F.when(inside(p, F.col("first"), F.col("c")), F.col("v")))
    found = found.groupBy(*keys, "total", "q").agg(pick(F.floor(pos)).alias("_lo"), pick(F.ceil(pos)).alias("_hi"))
    return found.select(*keys, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).alias("value"))


def describe(df: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = DESCRIBED) -> DataFrame:
    """Count, min, mean, population deviation, max, iqr and quantiles of each group's finite values.

    Groups without a finite value have count 0 and nulls.
    """
    x = finite(F.col(value).cast("double"))
    base = df.groupBy(keys).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max(x).alias("max"))
    name = lambda q: "p" + f"{q * 100:g}".replace(".", "_")
    wanted = tuple(sorted({*qs, 0.25, 0.75}))
    found = quantiles(distribution(df, keys, value), keys, wanted).groupBy(keys).agg(*[F.max(F.when(F.abs(F.col("q") - q) < 1e-9, F.col("value"))).alias(name(q)) for q in wanted])
    out = base.join(found, keys, "left") if keys else base.join(F.broadcast(found), how="left")  # without keys: one row
    return out.select(*base.columns, (F.col("p75") - F.col("p25")).alias("iqr"), *[name(q) for q in qs])


def paired_corr(df: DataFrame, keys: list[str], x: str, y: str, name: str = "corr", least_n: int = 3) -> DataFrame:
    """Pearson correlation of jointly finite pairs; null under least_n pairs or without spread."""
    a, b = finite(F.col(x).cast("double")), finite(F.col(y).cast("double"))
    both = df.select(*keys, a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    ok = (F.count("*") >= least_n) & (F.stddev_pop("a") >= 1e-12) & (F.stddev_pop("b") >= 1e-12)
    return both.groupBy(keys).agg(F.count("*").alias("n"), F.when(ok, F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias(name))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks of jointly finite pairs."""
    both = df.where(finite(F.col(x).cast("double")).isNotNull() & finite(F.col(y).cast("double")).isNotNull()).select(*keys, x, y)
    ranked = _with_each_rank(both, keys, {x: ("_rx", "_nx"), y: ("_ry", "_ny")}, [df])
    return paired_corr(ranked, keys, "_rx", "_ry", "spearman")


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, control: str, least_n: int = 20) -> DataFrame:
    """Correlation of the ranks of x and y, each freed of a quadratic in the control's rank.

    The residuals' moments follow from sums over the rows: the quadratic's design has
    orthogonal polynomials in the standardised rank, so no row is visited twice.
    """
    ok = [finite(F.col(c).cast("double")).isNotNull() for c in (x, y, control)]
    rows = df.where(ok[0] & ok[1] & ok[2]).select(*keys, x, y, control)
    of = _counted([df])
    rows = _with_each_rank(rows, keys, {c: (r, f"_n{r}") for c, r in ((x, "_a"), (y, "_b"), (control, "_r"))}, of).select(*keys, "_a", "_b", "_r")
    if not few(*of):
        rows = written(rows, "ranks")  # means come first, moments second
    base = rows.groupBy(keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("_a", "_b", "_r")], F.stddev_pop("_r").alias("s"))
    rows = rows.join(base, keys) if keys else rows.join(F.broadcast(base))  # without keys: one row
    z = (F.col("_r") - F.col("m_r")) / F.greatest(F.col("s"), F.lit(1e-12))
    rows = rows.select(*keys, "n", z.alias("z"), (F.col("_a") - F.col("m_a")).alias("a"), (F.col("_b") - F.col("m_b")).alias("b"))
    m = rows.groupBy(keys).agg(F.max("n").alias("n"), *[F.avg(F.expr(e)).alias(k) for k, e in {"z2": "z*z", "z3": "z*z*z", "z4": "z*z*z*z", "az": "a*z", "bz": "b*z", "az2": "a*z*z", "bz2": "b*z*z", "aa": "a*a", "bb": "b*b", "ab": "a*b"}.items()])
    # second polynomial: z^2 - z2 - (z3 / z2) z, orthogonal to 1 and z
    k = F.col("z3") / F.col("z2")
    norm = F.col("z4") - F.col("z2") * F.col("z2") - F.col("z3") * k
    ap, bp = F.col("az2") - k * F.col("az"), F.col("bz2") - k * F.col("bz")
    rest = lambda raw, u, v, p, q: F.col(raw) - F.col(u) * F.col(v) / F.col("z2") - F.when(norm > 1e-12, p * q / norm).otherwise(0.0)
    aa, bb, ab = rest("aa", "az", "az", ap, ap), rest("bb", "bz", "bz", bp, bp), rest("ab", "az", "bz", ap, bp)
    fine = (F.col("n") >= least_n) & (aa > 1e-24) & (bb > 1e-24)
    return m.select(*keys, "n", F.when(fine, ab / F.sqrt(aa * bb)).alias("partial_spearman"))


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """AUROC with average ranks for ties; null without both classes. Null labels are left out."""
    return _auc(distribution(df.where(F.col(positive).isNotNull()), keys, score, {"pos": F.col(positive).cast("boolean").cast("int")}), keys, "pos")


def _auc(dist: DataFrame, keys: list[str], positive: str) -> DataFrame:
    """auc of a distribution with the positive rows as a weight."""
    sums = dist.groupBy(keys).agg(F.sum(F.col(positive) * average_rank()).alias("s"), F.sum(positive).alias("n1"), F.max("n").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return sums.select(*keys, n1.cast("long").alias("n_positive"), n0.cast("long").alias("n_negative"), F.when((n1 > 0) & (n0 > 0), (F.col("s") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def sides(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """The distribution of rows with a side, with the rows of either side as weights: a where it is true, b where false."""
    first = F.col(side).cast("boolean").cast("int")
    return distribution(df.where(F.col(side).isNotNull()), keys, value, {"a": first, "b": 1 - first})


def ks(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Largest distance of the ECDFs of rows with side true and with side false; null if one is empty."""
    return _ks(sides(df, keys, value, side), keys)


def _ks(dist: DataFrame, keys: list[str]) -> DataFrame:
    """ks of the distribution that sides gives."""
    total = dist.groupBy(keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    both = dist.join(total, keys) if keys else dist.join(F.broadcast(total))  # without keys: one row
    gap = F.abs(F.col("a_upto") / F.col("na") - F.col("b_upto") / F.col("nb"))
    return both.groupBy(keys).agg(F.when((F.max("na") > 0) & (F.max("nb") > 0), F.max(F.when((F.col("na") > 0) & (F.col("nb") > 0), gap))).alias("ks"))


def ks_and_auc(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """ks, and the AUROC of the rows with side false, from one distribution."""
    dist = sides(df, keys, value, side)
    return _ks(dist, keys).join(_auc(dist, keys, "b").select(*keys, "auc"), keys)


def wasserstein(df: DataFrame, keys: list[str], value: str, side: str, steps: int = 2000) -> DataFrame:
    """Mean absolute difference of the two sides' quantiles on a grid of steps + 1 points."""
    return _wasserstein(distribution(df.where(F.col(side).isNotNull()), [*keys, side], value), keys, side, steps)


def _wasserstein(dist: DataFrame, keys: list[str], side: str, steps: int = 2000) -> DataFrame:
    """wasserstein of the distribution of each side."""
    grid = grid_quantiles(dist, [*keys, side], steps)
    wide = grid.groupBy(*keys, "i").agg(F.max(F.when(F.col(side), F.col("value"))).alias("a"), F.max(F.when(~F.col(side), F.col("value"))).alias("b"))
    return wide.groupBy(keys).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("wasserstein"))


def quantile_gap(df: DataFrame, keys: list[str], value: str, reference: str, floor: float = 0.05) -> DataFrame:
    """Mean absolute difference of seven quantiles over the reference side's IQR (at least floor)."""
    return _quantile_gap(distribution(df.where(F.col(reference).isNotNull()), [*keys, reference], value), keys, reference, floor)


def _quantile_gap(dist: DataFrame, keys: list[str], reference: str, floor: float = 0.05) -> DataFrame:
    """quantile_gap of the distribution of each side."""
    found = quantiles(dist, [*keys, reference], GAP)
    wide = found.groupBy(*keys, "q").agg(F.max(F.when(F.col(reference), F.col("value"))).alias("r"), F.max(F.when(~F.col(reference), F.col("value"))).alias("t"))
    iqr = F.max(F.when(F.col("q") == 0.75, F.col("r"))) - F.max(F.when(F.col("q") == 0.25, F.col("r")))
    return wide.groupBy(keys).agg((F.avg(F.abs(F.col("t") - F.col("r"))) / F.greatest(iqr, F.lit(floor))).alias("quantile_gap"))


def gap_and_wasserstein(df: DataFrame, keys: list[str], value: str, reference: str) -> DataFrame:
    """quantile_gap and wasserstein from one distribution of each side."""
    dist = distribution(df.where(F.col(reference).isNotNull()), [*keys, reference], value)
    return _quantile_gap(dist, keys, reference).join(_wasserstein(dist, keys, reference), keys)


def quantisation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Levels of a channel: distinct values (to 6 digits), sign fractions, steps between levels, entropy."""
    x = finite(F.col(value).cast("double"))
    rows = df.withColumn("x", x).where("x is not null").withColumn("level", F.bround("x", 6))
    levels = distribution(rows, keys, "level", of=[df])
    by = None
    if not few(df):
        levels, by = _cut(levels, keys), F.col("_cut")
    levels = scan(levels, keys, by, ["v"], previous={"_before": F.col("v")}, of=[df])
    p = F.col("c") / F.col("n")
    steps = levels.withColumns({"step": F.col("v") - F.col("_before"), "h": -p * F.log2(p)})
    positive = F.when(F.col("step") > 1e-9, F.col("step"))
    per = steps.groupBy(keys).agg(F.count("*").alias("unique_values"), F.sum("h").alias("entropy_bits"), F.min(positive).alias("min_step"))
    middle = percentiles(steps, keys, {"median_step": (positive, 0.5)}, [df])
    per = per.join(middle, keys) if keys else per.join(F.broadcast(middle))  # without keys: one row
    share = lambda c: F.avg(c.cast("double"))
    base = rows.groupBy(keys).agg(F.count("*").alias("samples"), share(F.abs("x") <= 1e-8).alias("zero_fraction"), share(F.col("x") < 0).alias("negative_fraction"), share(F.col("x") > 0).alias("positive_fraction"), F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    out = base.join(per, keys) if keys else base.join(F.broadcast(per))  # without keys: one row
    return out.withColumns({"unique_fraction": F.col("unique_values") / F.col("samples"), "effective_levels": F.pow(F.lit(2.0), "entropy_bits")})


def deciles(df: DataFrame, keys: list[str], percentile: str, distance: str, near: float = 0.2) -> DataFrame:
    """Distance quartiles and near fractions in (low, high] tenths of a percentile; 0 joins the first."""
    p = F.col(percentile)
    edges = F.array(*[F.lit(i / 10.0) for i in range(1, 10)])
    rows = df.where(p.isNotNull() & finite(F.col(distance)).isNotNull()).withColumn("decile", 1 + F.size(F.filter(edges, lambda e: p > e)))
    group = [*keys, "decile"]
    share = lambda limit: F.avg((F.col(distance) <= limit).cast("double"))
    base = rows.groupBy(group).agg(F.count("*").alias("points"), share(0.1).alias("within_10"), share(near).alias("within_near"), share(0.3).alias("within_30"))
    q = quantiles(distribution(rows, group, distance), group, (0.25, 0.5, 0.75))
    wide = q.groupBy(group).agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for x, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))])
    return base.join(wide, group)


def in_bins(df: DataFrame, value: str, edges: list[float], name: str = "bin") -> DataFrame:
    """Rows inside [low, high) bins of strictly increasing edges, with the bin's number from 0."""
    if any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("bin edges must be strictly increasing")
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(value))) - 1
    return df.withColumn(name, at).where((F.col(name) >= 0) & (F.col(name) < len(edges) - 1))


def range_bins(df: DataFrame, keys: list[str], range_col: str, edges: list[float], score: str, positive: str, least: int = 50) -> DataFrame:
    """Spearman of score with the label and AUROC in each range bin of at least `least` rows."""
    rows = in_bins(df, range_col, edges).withColumn("_y", F.col(positive).cast("boolean").cast("double"))
    group = [*keys, "bin"]
    n = rows.groupBy(group).agg(F.count("*").alias("points")).where(F.col("points") >= least)
    return n.join(spearman(rows, group, score, "_y").drop("n"), group).join(auc(rows, group, score, positive), group)


def minmax(df: DataFrame, keys: list[str], value: str, reverse: bool = False, name: str = "scaled") -> DataFrame:
    """Finite values scaled to 0..1 in each group; a constant gives 0, other values 1."""
    x = finite(F.col(value).cast("double"))
    span = df.groupBy(keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    out = df.join(span, keys) if keys else df.join(F.broadcast(span))  # without keys: one row
    part = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return out.withColumn(name, F.when(x.isNull(), 1.0).otherwise(1 - part if reverse else part)).drop("_lo", "_hi")


def robust_scale(df: DataFrame, keys: list[str], value: str, clip: float = 5.0, name: str = "robust") -> DataFrame:
    """(x - median) over IQR (at least 1e-6), cut to [-clip, clip] and divided by clip."""
    q = quantiles(distribution(df, keys, value), keys, (0.25, 0.5, 0.75)).groupBy(keys).agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for x, n in ((0.25, "_q1"), (0.5, "_m"), (0.75, "_q3"))])
    out = df.join(q, keys, "left") if keys else df.join(F.broadcast(q), how="left")  # without keys: one row
    z = (F.col(value) - F.col("_m")) / F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1e-6))
    return out.withColumn(name, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) / clip).drop("_q1", "_m", "_q3")


def support_overlap(df: DataFrame, keys: list[str], value: str, reference: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Share of the other side's values under, over and inside the reference side's outer quantiles."""
    q = quantiles(distribution(df.where(F.col(reference)), keys, value), keys, (low, high)).groupBy(keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rows = df.where(~F.col(reference)).withColumn("x", finite(F.col(value).cast("double"))).where("x is not null")
    rows = rows.join(q, keys) if keys else rows.join(F.broadcast(q))  # without keys: one row
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(keys).agg(F.count("*").alias("n"), share(F.col("x") < F.col("_lo")).alias("below"), share(F.col("x") > F.col("_hi")).alias("above"), share(F.col("x").between(F.col("_lo"), F.col("_hi"))).alias("within"))


def proximity_summary(df: DataFrame, signal: str, distance: str, range_col: str, near: float, clutter: float) -> DataFrame:
    """How a signal tells near from clutter points: correlations, AUROC, outer quartiles. One row.

    Points neither near nor clutter count in all but the AUROC.
    """
    rows = df.where(finite(F.col(signal)).isNotNull() & finite(F.col(distance)).isNotNull()).withColumns({"_close": -F.col(distance), "_near": F.col(distance) <= near})
    classed = rows.where(F.col("_near") | (F.col(distance) > clutter))
    q = quantiles(distribution(rows, [], signal), [], (0.25, 0.75)).agg(F.min("value").alias("_q1"), F.max("value").alias("_q3"))
    ends = rows.join(F.broadcast(q)).withColumn("end", F.explode(F.array_compact(F.array(F.when(F.col(signal) <= F.col("_q1"), "bottom"), F.when(F.col(signal) >= F.col("_q3"), "top")))))
    halves = quantiles(distribution(ends, ["end"], distance), ["end"], (0.5,)).join(ends.groupBy("end").agg(F.avg(F.col("_near").cast("double")).alias("share")), "end")
    pick = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    halves = halves.agg(pick("bottom", "value").alias("median_distance_bottom_quartile"), pick("top", "value").alias("median_distance_top_quartile"), pick("bottom", "share").alias("near_fraction_bottom_quartile"), pick("top", "share").alias("near_fraction_top_quartile"))
    out = rows.agg(F.count("*").alias("points"), F.count_if("_near").alias("near_points"), F.count_if(F.col(distance) > clutter).alias("clutter_points"))
    for part in (spearman(rows, [], signal, "_close").select("spearman"), partial_spearman(rows, [], signal, "_close", range_col).select("partial_spearman"), auc(classed, [], signal, "_near").select("auc"), halves):
        out = out.join(F.broadcast(part))  # one row each
    return out
