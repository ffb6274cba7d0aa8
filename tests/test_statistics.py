"""Distribution statistics against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import statistics as st


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(("a", "b")[i % 2], float(np.round(x, 1)), float(y), bool(i % 3 == 0)) for i, (x, y) in enumerate(rng.normal(size=(600, 2)))]
    return [*out, ("a", float("nan"), 1.0, True), ("b", float("inf"), 1.0, False)]


def test_against_numpy(spark, rows):
    from chronoweave.operators import statistics as st

    df = spark.createDataFrame(rows, "g string, x double, y double, side boolean")
    ok = [r for r in rows if np.isfinite(r[1])]
    x, y, side = (np.array([r[k] for r in ok]) for k in (1, 2, 3))
    d = st.describe(df, [], "x").first()
    assert d["count"] == 600 and np.allclose([d["mean"], d["std"], d["iqr"], d["p0_1"], d["p99_9"]], [x.mean(), x.std(), np.quantile(x, 0.75) - np.quantile(x, 0.25), np.quantile(x, 0.001), np.quantile(x, 0.999)])
    u, c = np.unique(x, return_counts=True)
    rank = {v: s - (k - 1) / 2 for v, s, k in zip(u, np.cumsum(c), c, strict=True)}
    r = np.array([rank[v] for v in x])
    n1 = side.sum()
    assert abs(st.auc(df, [], "x", "side").first().auc - (r[side].sum() - n1 * (n1 + 1) / 2) / (n1 * (600 - n1))) < 1e-12
    ecdf = lambda a: np.searchsorted(np.sort(a), u, "right") / len(a)
    assert abs(st.ks(df, [], "x", "side").first().ks - np.abs(ecdf(x[side]) - ecdf(x[~side])).max()) < 1e-12
    q = np.linspace(0, 1, 2001)
    assert abs(st.wasserstein(df, [], "x", "side").first().wasserstein - np.abs(np.quantile(x[side], q) - np.quantile(x[~side], q)).mean()) < 1e-9
    yr = np.argsort(np.argsort(y)) + 1.0
    assert abs(st.spearman(df, [], "x", "y").first().spearman - np.corrcoef(r, yr)[0, 1]) < 1e-9
    z = (r - r.mean()) / r.std()
    a = np.stack([np.ones(600), z, z * z], 1)
    rest = lambda v: v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
    w = np.array([i % 7 + i / 1000 for i in range(600)])
    more = spark.createDataFrame([(float(p), float(q_), float(s)) for p, q_, s in zip(y, w, x, strict=True)], "a double, b double, c double")
    wr = np.argsort(np.argsort(w)) + 1.0
    assert abs(st.partial_spearman(more, [], "a", "b", "c").first().partial_spearman - np.corrcoef(rest(yr), rest(wr))[0, 1]) < 1e-6
    assert st.describe(df.where("x > 1e9 and not isnan(x) and x < 1e300"), [], "x").first()["count"] == 0
    with pytest.raises(ValueError):
        st.in_bins(df, "x", [1.0, 1.0])


def test_empty_sides(spark):
    from chronoweave.operators import statistics as st

    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True)], "g string, x double, side boolean")
    assert st.auc(df, ["g"], "x", "side").first().auc is None
    assert st.ks(df, ["g"], "x", "side").first().ks is None


@pytest.fixture
def many(monkeypatch):
    """Every table counts as large, with small slices and few buckets."""
    from chronoweave.operators import scan, statistics

    monkeypatch.setattr(scan, "WHOLE", 0)
    monkeypatch.setattr(statistics, "SLICE_VALUES", 16)
    monkeypatch.setattr(statistics, "BUCKETS", 8)


def spread(spark):
    """Groups of wide, narrow, tied, huge and no finite values; a null group."""
    rnd = random.Random(7)
    draw = {"wide": lambda: rnd.gauss(0, 1e6), "narrow": lambda: 1 + rnd.random() * 1e-9, "tied": lambda: float(rnd.randint(0, 5)), "huge": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(0, 308), None: lambda: rnd.expovariate(1)}
    rows = [(g, f(), rnd.random()) for g, f in draw.items() for _ in range(rnd.randint(150, 300))]
    rows += [("none", math.nan, 0.0), ("none", None, 0.0), ("wide", math.inf, 1.0), ("one", 3.0, 0.0), ("tied", -0.0, 0.5)]
    return spark.createDataFrame(rows, "g string, v double, w double"), rows


def test_percentiles_by_refinement(spark, many):
    df, rows = spread(spark)
    wanted = {"least": (F.col("v"), 0.0), "half": (F.col("v"), 0.5), "tail": (F.col("v"), 0.95), "top": (F.col("v"), 1.0), "other": (-F.col("w"), 0.25)}
    found = {r.g: r for r in st.percentiles(df, ["g"], wanted).collect()}
    assert set(found) == {r[0] for r in rows}
    for g, r in found.items():
        v = [x for h, x, _ in rows if h == g and x is not None and math.isfinite(x)]
        w = [-y for h, _, y in rows if h == g]
        assert r.other == pytest.approx(np.quantile(w, 0.25), rel=1e-12)
        assert (r.least, r.half, r.tail, r.top) == (pytest.approx([np.quantile(v, q) for q in (0, 0.5, 0.95, 1)], rel=1e-9) if v else (None,) * 4)
    whole = st.percentiles(df.where("g = 'wide'"), [], {"half": (F.col("v"), 0.5)}).first()
    assert whole.half == pytest.approx(found["wide"].half)


def test_distribution_in_slices(spark, many):
    """Cuts follow each group's own values: narrow groups have slices too; ranks and sums are right."""
    df, rows = spread(spark)
    dist = st.distribution(df, ["g"], "v", {"w": F.col("w")})
    cut = st._cut(dist.select("g", "v"), ["g"]).groupBy("g").agg(F.countDistinct("_cut").alias("slices")).collect()
    slices = {r.g: r.slices for r in cut}
    assert min(slices[g] for g in ("wide", "narrow", "huge")) > 4 and slices["one"] == 1
    for r in dist.collect():
        mine = [(x + 0.0, y) for h, x, y in rows if h == r.g and x is not None and math.isfinite(x)]
        assert (r.n, r.upto, r.c) == (len(mine), sum(x <= r.v for x, _ in mine), sum(x == r.v for x, _ in mine))
        assert r.w_upto == pytest.approx(sum(y for x, y in mine if x <= r.v))


def test_ranks_do_not_depend_on_the_path(spark, monkeypatch):
    from chronoweave.operators import scan

    df, rows = spread(spark)
    known = df.where("g is not null")
    small = sorted(map(str, st.with_ranks(known, ["g"], "v").collect()))
    pair = st.spearman(known, ["g"], "v", "w").orderBy("g").collect()
    monkeypatch.setattr(scan, "WHOLE", 0)
    monkeypatch.setattr(st, "SLICE_VALUES", 16)
    assert sorted(map(str, st.with_ranks(known, ["g"], "v").collect())) == small
    assert [(r.g, r.n, r.spearman) for r in st.spearman(known, ["g"], "v", "w").orderBy("g").collect()] == [(r.g, r.n, r.spearman if r.spearman is None else pytest.approx(r.spearman)) for r in pair]
