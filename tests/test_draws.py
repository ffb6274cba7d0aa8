"""Draws and selections against a full sort."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import frames as fr


@pytest.fixture(params=[1, 12])
def points(spark, request, monkeypatch):
    """Rows of uneven strata, one null; with many hash slices and with two."""
    monkeypatch.setattr(fr, "SLICE_BITS", request.param)
    rnd = random.Random(5)
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), rnd.random() < 0.3, k) for k in range(600)] + [("c", True, 1000)]
    return spark.createDataFrame(rows, "g string, side boolean, id long")


def by_hash(df, keys, seed):
    """Rows of each group in the order of the draw."""
    out = collections.defaultdict(list)
    for r in df.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").collect():
        out[tuple(r[k] for k in keys)].append((r.g, r.side, r.id))
    return out


def taken(df):
    return sorted(map(tuple, df.select("g", "side", "id").collect()), key=str)


def test_draws(points):
    n = points.count()
    for maximum in (1, 37, n, n + 5):
        assert taken(fr.random_cap(points, ["id"], maximum, 3)) == sorted(by_hash(points, [], 3)[()][:maximum], key=str)
    want = [r for rows in by_hash(points, ["g"], 4).values() for r in rows[: max(1, round(100 * len(rows) / n))]]
    assert taken(fr.stratified_cap(points, ["g"], ["id"], 100, 4)) == sorted(want, key=str)
    sides = by_hash(points, ["g", "side"], 5)
    want = [r for (g, _), rows in sides.items() for r in rows[: min(len(sides.get((g, s), [])) for s in (True, False))]]
    assert taken(fr.matched_sample(points, ["g"], "side", ["id"], 5)) == sorted(want, key=str)
    per = math.ceil(50 / 4)
    first = sorted((r for rows in by_hash(points, ["g"], 6).values() for r in rows[:per]), key=str)
    got = taken(fr.balanced_reservoir(points, ["g"], ["id"], 50, 6))
    assert len(got) == min(50, len(first)) and set(got) <= set(first) and len(got) == len(set(got))


def test_subject_split(points):
    found = {r.id: r.part for r in fr.subject_split(points, "id", 0.2, 0.1, 2).collect()}
    order = [r[2] for r in by_hash(points.select("g", "side", "id"), [], 2)[()]]
    n = len(order)
    want = {k: "test" if i < round(0.2 * n) else "validation" if i < round(0.2 * n) + round(0.1 * n) else "training" for i, k in enumerate(order)}
    assert found == want


def test_even_selection(spark, monkeypatch):
    from chronoweave.operators import scan

    rows = [(g, k) for g, n in (("a", 1000), ("b", 7), ("c", 1), (None, 50)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, t long")
    for whole in (10**6, 0):
        monkeypatch.setattr(scan, "WHOLE", whole)
        monkeypatch.setattr(scan, "INDEX_SLICE", 13)
        for maximum in (1, 2, 9, 50):
            got = collections.defaultdict(set)
            for r in fr.even_subsample(df, ["g"], ["t"], maximum).collect():
                got[r.g].add(r.t)
            for g in ("a", "b", "c", None):
                n = sum(x == g for x, _ in rows)
                assert got[g] == set(np.linspace(0, n - 1, maximum).astype(int).tolist() if n > maximum else range(n)), (g, maximum)
    parts = fr.calibration_split(df, ["g"], ["t"], 0.3).where("part = 'calibration'").groupBy("g").agg(F.count("*").alias("n"), F.max("t").alias("last")).collect()
    assert {r.g: (r.n, r.last) for r in parts} == {"a": (300, 299), "b": (6, 5), "c": (1, 0), None: (15, 14)}
