"""What a vector's walk sends is bounded in bytes, and its cells follow the size of its label."""

import numpy as np
import pyarrow as pa

SCHEMA = "vec_id long, label string, embedding array<double>"


def test_walks_leave_in_bounded_batches(spark, monkeypatch):
    from chronoweave.llm import vector_dedup as vd

    sent = []
    whole = vd.map_batches

    def kept(df, fn, schema):
        if "v array<double>" in schema:
            sent.append(fn)
        return whole(df, fn, schema)

    monkeypatch.setattr(vd, "map_batches", kept)
    monkeypatch.setattr(vd, "BATCH_BYTES", 1 << 16)
    x = np.random.default_rng(2).normal(size=(600, 4))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    vd.near_duplicates(df, words=16, least=0.5, exact=True)
    rows = pa.record_batch([pa.array(["a"] * 600), pa.array(x.tolist()), pa.array(range(600)), pa.array([1] * 600)], ["label", "v", "vec_id", "n"])
    out = list(sent[-1](iter([rows])))
    assert sum(b.num_rows for b in out) > 10 * 600 and max(b.num_rows * (8 * 4 + 64) for b in out) <= 1 << 16


def test_cells_follow_the_size_of_a_label(spark, monkeypatch):
    from chronoweave.llm import vector_dedup as vd

    words = []
    book = vd.codebook
    monkeypatch.setattr(vd, "codebook", lambda half, n: words.append(n) or book(half, n))
    x = np.random.default_rng(3).normal(size=(3200, 8))
    for labels in (1, 8):
        vd.near_duplicates(spark.createDataFrame([(i, str(i % labels), v.tolist()) for i, v in enumerate(x)], SCHEMA))
    # 3,200 vectors of one label, and 400 of each of eight
    assert words == [10, 10, 4, 4]
