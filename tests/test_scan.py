"""Running values in slices, against one pass in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import scan as sc


@pytest.fixture
def sliced(monkeypatch):
    """Every scan in slices, however few rows there are."""
    monkeypatch.setattr(sc, "WHOLE", 0)


def walked(rows):
    """(group, t, id, v) with n, last seen v, the v before, and the group's least and most v."""
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in mine if r[3] is not None]
        last = before = None
        for n, r in enumerate(mine):
            last = r[3] if r[3] is not None else last
            out.append((*r, n + 1, last, before, min(values, default=None), max(values, default=None)))
            before = r[3]
    return sorted(out, key=str)


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "g string, t long, id long, v long")
    v = F.col("v")
    out = sc.scan(df, ["g"], F.floor(F.col("t") / 7), ["t", "id"], sums={"n": F.lit(1)}, lasts={"last": v}, previous={"before": v}, wholes={"low": (F.min, v), "high": (F.max, v)})
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("whole", [0, 10**6])
def test_scan(spark, monkeypatch, whole):
    monkeypatch.setattr(sc, "WHOLE", whole)
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(-50, 50), k, rnd.choice([None, None, rnd.randint(0, 9)])) for k in range(400)]
    assert scanned(spark, rows) == walked(rows)
    assert scanned(spark, []) == []


def test_one_long_group_spreads_over_tasks(spark, sliced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200_000).select(F.lit("one").alias("g"), F.col("id").alias("t"), F.col("id"))
        out = sc.numbered(rows, ["g"], F.floor(F.col("t") / 5_000), ["t"]).withColumn("task", F.spark_partition_id())
        found = out.groupBy("task").agg(F.count("*").alias("rows"), F.bool_and(F.col("n") == F.col("id")).alias("right")).collect()
        assert all(r.right for r in found) and sum(r.rows for r in found) == 200_000
        assert len(found) == 4 and max(r.rows for r in found) < 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_queries_in_slices(spark, sf_dir, sliced, monkeypatch):
    """What the queries give does not depend on slices; these are a week long here."""
    from chronoweave import queries as core
    from chronoweave.queries import alignment, data

    names = ["sample_numbers", "anchor_pairs", "piecewise_segments", "piecewise_predict", "piecewise_loo", "piecewise_mapping", "nearest_topk", "lookup_inverse", "change_segments"]
    week = 7 * 86_400_000_000
    for m in (data, alignment):
        monkeypatch.setattr(m, "SPARSE", week)
    run = lambda n: sorted(map(str, core.queries()[n](spark, sf_dir).collect()))
    cut = {n: run(n) for n in names}
    monkeypatch.setattr(sc, "WHOLE", 10**6)
    for n in names:
        assert run(n) == cut[n] and cut[n], n
