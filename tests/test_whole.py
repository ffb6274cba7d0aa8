"""Queries over the whole of their tables, against SQL without a cut."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("events", "documents", "embeddings")
ANCHORED = ["anchor_pairs", "piecewise_segments", "piecewise_predict", "piecewise_predict_inside", "piecewise_residuals", "piecewise_loo", "piecewise_mapping"]
CASES = ["theil_sen", "slugs", *ANCHORED]


def same(v):
    return (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def wide():
    """A scale where the tables are larger than what the cuts kept."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    return "/root/testdata/sf0.1", con


@pytest.mark.parametrize("name", CASES)
def test_equals_sql_on_the_wide_scale(spark, wide, name):
    sf_dir, con = wide
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([same(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_theil_sen_reads_every_vector(spark, wide):
    sf_dir, con = wide
    rows = entry.queries()["theil_sen"](spark, sf_dir).collect()
    assert {r.block for r in rows} == {0, 1, 2, 3}  # 2,000 vectors in blocks of 500


def test_anchors_leave_out_only_what_breaks_the_order(spark):
    from chronoweave.queries.data import anchors

    times = [(1, 1), (1, 2), (2, 2), (3, 3), (4, 3), (5, 4)]
    rows = [(1, kind, k, pair[side] * 1_000_000) for k, pair in enumerate(times) for side, kind in enumerate(("click", "purchase"))]
    kept = anchors(spark.createDataFrame(rows, "user_id long, event_type string, sample_index long, t long"))
    assert sorted(r.sample_index for r in kept.collect()) == [0, 2, 3, 5]


def test_slugs_read_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, " -" * 40 + "ä" * 40 + "word " * 9, "s", "en"), (2, "." + "é" * 90 + "end", "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.slug for r in entry.queries()["slugs"](spark, str(tmp_path)).collect()}
    assert found == {1: "-_" * 15, 2: "._end"}
