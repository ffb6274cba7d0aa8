"""Work that grows with the input alone, measured as rows or bytes of a step."""

import numpy as np

from chronoweave.operators import pose as ps

POSE = "array<array<double>>"


def test_axis_searches_do_not_repeat_rows_for_each_transform(spark, monkeypatch):
    """48 transforms of the same axes: distributions get each number once, medians 18 pairs of axes."""
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=(17, 3)).tolist(), rng.normal(size=(4, 6)).tolist()) for k in range(10)]
    df = spark.createDataFrame(rows, f"frame long, pose {POSE}, points {POSE}")
    seen = []
    distribution, percentiles = ps.distribution, ps.percentiles

    def counted(f):
        def run(rows, *args, **more):
            seen.append(rows.count())
            return f(rows, *args, **more)

        return run

    monkeypatch.setattr(ps, "distribution", counted(distribution))
    monkeypatch.setattr(ps, "percentiles", counted(percentiles))
    assert ps.pose_axis_search(df, df, "pose").count() == 48 and max(seen) == 10 * 45
    seen.clear()
    flat = df.selectExpr("explode(points) as point")
    assert ps.point_axis_search(flat, flat, "point").count() == 48 and max(seen) == 40 * 3
    seen.clear()
    assert ps.axis_search(df, "frame", "points", "pose").count() == 48 and sorted(seen) == [10 * 18, 10 * 48]


def test_a_pose_is_moved_once(spark):
    """The 17 joints come from one pass over the joints, not one pass for each of them."""
    from pyspark.sql import functions as F

    from chronoweave.functions import geometry as g

    df = spark.createDataFrame([([[[float(3 * j + a) for a in range(3)] for j in range(32)]],)], f"people array<{POSE}>")
    out = df.select(g.pose_17(F.col("people"), 0, (10.0, 20.0, 30.0), (0.1, 0.2, 0.3)).alias("p"))
    assert out._jdf.queryExecution().analyzed().toString().count("transform(") <= 4
    turn = np.array(g.euler_rotation(*np.radians([10.0, 20.0, 30.0])))
    want = [turn @ (np.array([3 * j, 3 * j + 2, -(3 * j + 1)]) / 1000) + [0.1, 0.2, 0.3] for j in g.JOINTS_32_TO_17]
    assert np.allclose(out.first().p, want)


def test_ranks_of_several_columns_count_and_join_rows_once(spark, monkeypatch):
    """Each column's distribution comes from the rows as they are, which are counted once."""
    from chronoweave.operators import scan
    from chronoweave.operators import statistics as st

    df = spark.createDataFrame([("a", float(i % 7), float(i % 5), float(i % 3)) for i in range(60)], "k string, x double, y double, z double")
    small = st.partial_spearman(df, ["k"], "x", "y", "z").collect()
    monkeypatch.setattr(scan, "WHOLE", 0)
    plans, distribution = [], st.distribution

    def seen(rows, *args, **more):
        plans.append(rows._jdf.queryExecution().analyzed().toString().count("Join"))
        assert all(isinstance(x, int) for x in more["of"])
        return distribution(rows, *args, **more)

    monkeypatch.setattr(st, "distribution", seen)
    large = st.partial_spearman(df, ["k"], "x", "y", "z").collect()
    assert plans == [0, 0, 0] and abs(large[0].partial_spearman - small[0].partial_spearman) < 1e-12


def test_a_slug_reads_no_further_than_it_shows(spark):
    """The same slug as from the whole text, whose rest is not rewritten."""
    import re

    from pyspark.sql import functions as F

    from chronoweave.functions.names import slugify

    whole = lambda t, n: re.sub("[^A-Za-z0-9_.-]+", "_", t).strip("_")[:n] or "unknown"
    texts = ["", "_", "__ a", "a", "abc__", "abc _ _", "abc _ _ d", "ab\ncdé\U0001f600ef" * 9, " " * 500 + "x" * 3 + " " * 500 + "y", "a b " * 50, "abcd" + "_" * 40, "abcd" + " " * 40 + ".", "ab_", "ab_c", "_" * 90 + "-" * 90, "\U0001f600" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for n in (1, 2, 3, 4, 5, 30, 100, 1000):
        out = df.select("i", slugify(F.col("t"), n).alias("s"))
        assert {r.i: r.s for r in out.collect()} == {i: whole(t, n) for i, t in enumerate(texts)}
        assert ("regexp_extract" in out._jdf.queryExecution().analyzed().toString()) == (n <= 100)
