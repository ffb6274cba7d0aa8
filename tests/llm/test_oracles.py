"""Registered queries of the subpackage against their DuckDB SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["op5_top_k", "op6_jaccard", "op7_vector_dedup", "op8_mixing", "op11_quality_rules", "op12_lexical_search", "op13_vector_codes", "licenses_base"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    same = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted(repr([same(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([same(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert len(got) == len(want)
    assert got == want
