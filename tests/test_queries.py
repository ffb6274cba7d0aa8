"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["nearest_topk", "overlap_pairs", "piecewise_predict", "lookup_inverse", "describe", "auc", "ks", "change_segments", "temporal_split", "index_window", "slugs", "ols_residuals",
        "supervised_windows", "inference_windows", "diagnostic_windows", "bin_labels", "run_limits", "available_roles", "missing_summary", "ols_report", "lookup_forward", "skeleton_distance", "projected_points", "joint_statistics", "frame_geometry", "signal_relationships", "normalisation_comparison", "model_feature_gaps"]


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([same(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
