"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=8) * (0.03 if i % 3 else 0.5)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 40 % 4)))
    rows += [(1000 + k, rows[20][1], 0) for k in range(60)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("inf")] + [1.0] * 7, 1), (2004, rows[20][1], None), (2005, [1.0, 2.0], 1), (2006, [None] + [1.0] * 7, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, n int, v string, cell int")


def good(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark, vectors):
    from chronoweave.llm.vector_topk import top_k

    got: dict = {}
    for r in top_k(frame(spark, vectors), F.col("vec_id") % 20 == 0, k=20, pivots=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    use = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in vectors if good(v)]
    ids, m = np.array([i for i, _ in use]), np.stack([v for _, v in use])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q in got:
        s = m @ m[ids == q][0]
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(got[q]) == [(n + 1, int(ids[k]), int(s[k])) for n, k in enumerate(best)]
    few = top_k(frame(spark, vectors[:3]), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 2
    assert top_k(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("words", [1, 4])
def test_near_duplicates(spark, vectors, words):
    from chronoweave.llm.vector_dedup import near_duplicates

    out = {r.vec_id: r for r in near_duplicates(frame(spark, vectors), words=words).collect()}
    assert len(out) == len(vectors)
    ok = [i for i, (_, v, lab) in enumerate(vectors) if good(v) and any(v) and lab is not None]
    m = np.array([vectors[i][1] for i in ok])
    lab = np.array([vectors[i][2] for i in ok])
    n = np.sqrt((m * m).sum(1))
    link = ((m @ m.T) / (n[:, None] * n[None]) >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    ids = np.array([vectors[i][0] for i in ok])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None], 1 << 60).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for k, i in enumerate(ids.tolist()):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (int(link[k].sum()), int(comp[k]), bool(comp[k] == i))
    for i in set(out) - set(ids.tolist()):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_visits_reach_all_within_radius():
    from chronoweave.llm.vector_dedup import MultiIndex

    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = MultiIndex(x[:200], 6)
    cell = index.cells(x)
    who, where = index.visits(x, 0.4)
    seen = set(zip(who.tolist(), where.tolist(), strict=True))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert all((a, int(cell[b])) in seen for a, b in zip(*np.nonzero(d <= 0.4), strict=True))
    assert len(seen) < 600 * 36 * 0.9


def test_recall_of_the_index_against_brute_force(spark):
    """64 dimensions: the walk stops by the target recall, not by the radius."""
    from chronoweave.llm.vector_dedup import MultiIndex, near_duplicates

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(8)
    for k in range(600):  # near copies, up to the limit
        v = np.array(rows[k % 200][1], np.float64)
        step = rng.normal(size=64)
        step *= np.linalg.norm(v) * rng.uniform(0.05, 0.199) / np.linalg.norm(step)
        rows.append((10_000 + k, [float(np.float32(x)) for x in v + step], rows[k % 200][2]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    m = np.array([v for _, v, _ in rows], np.float64)
    lab = np.array([x for _, _, x in rows])
    n = np.sqrt((m * m).sum(1))
    link = ((m @ m.T) / (n[:, None] * n[None]) >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    found = {r.vec_id: r.n_links for r in near_duplicates(table).collect()}
    want = int(link.sum())
    assert want > 100 and sum(found.values()) >= 0.99 * want
    assert all(found[i] <= k for (i, _, _), k in zip(rows, link.sum(1).tolist(), strict=True))
    unit = m / n[:, None]
    index = MultiIndex(unit, 16)
    stop = index.stop(0.2)
    assert stop < 0.13
    who, cells = index.visits(unit, stop)
    assert len(cells) < 0.2 * len(unit) * 256  # a fraction of the grid
    assert all(np.unique(cells[who == v]).size == (who == v).sum() for v in range(50))  # no cell twice


@pytest.mark.parametrize("axes", [1, 3])
def test_partners_along_few_axes(spark, axes):
    """Copies that differ along few directions: nine in ten at the target recall, every one if exact."""
    from chronoweave.llm.vector_dedup import near_duplicates

    rng = np.random.default_rng(9)
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = np.zeros((600, 64))
    step[:, :axes] = rng.normal(size=(600, axes))
    moved = base + step * (rng.uniform(0.12, 0.19, 600) / np.linalg.norm(step, axis=1))[:, None]
    m = np.concatenate([base, moved])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    assert want.sum() > 900
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>, label int")
    got = [{r.vec_id: r.n_links for r in near_duplicates(df, words=64, exact=exact).collect()} for exact in (False, True)]
    assert sum(got[0].values()) >= 0.9 * want.sum()
    assert [got[1][i] for i in range(len(m))] == want.tolist()


def test_codebooks_grow_within_bounds(monkeypatch):
    from chronoweave.llm import vector_dedup as vd

    half = np.random.default_rng(1).normal(size=(9000, 6))
    book = vd.codebook(half, 300, rounds=2)
    assert book.shape == (300, 6) and np.isfinite(book).all()


def test_top_k_sends_a_vector_where_it_matters(spark):
    from chronoweave.llm import vector_topk as vt

    rng = np.random.default_rng(2)
    centres = 40 * np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(i, [float(x) for x in centres[i % 16] + 0.1 * rng.normal(size=16)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    best = vt._best
    counted = spark.sparkContext.accumulator(0)

    made, all_pairs = (spark.sparkContext.accumulator(0) for _ in range(2))

    def counting(q, x, k, bounds, between):
        counted.add(x.num_rows)
        all_pairs.add(q.num_rows * x.num_rows)
        cell, d = x.column("cell").to_numpy(), x.column("d").to_numpy()
        for part in q.column("part").to_pylist():
            made.add(int(vt._concerns(part, *bounds[part], between, cell, d).sum()))
        return best(q, x, k, bounds, between)

    vt._best = counting
    block, vt.QUERY_BLOCK = vt.QUERY_BLOCK, 8
    try:
        got = vt.top_k(df, F.col("vec_id") % 20 == 0, k=5, pivots=64).collect()
    finally:
        vt._best, vt.QUERY_BLOCK = best, block
    sent.append(counted.value / 1600)
    m = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    for q in range(0, 1600, 20):
        s = m @ m[q]
        want = [k for k in np.lexsort((np.arange(1600), -s)) if k != q][:5]
        assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == q) == [(n + 1, int(k)) for n, k in enumerate(want)]
    assert sent[0] < 8, sent  # of ten groups or more
    # with all queries in one joined group, each group's own bound still leaves most products out
    made.value = all_pairs.value = 0
    vt._best = counting
    try:
        assert sorted(map(tuple, vt.top_k(df, F.col("vec_id") % 20 == 0, k=5, pivots=64).collect())) == sorted(map(tuple, got))
    finally:
        vt._best = best
    assert 0 < made.value <= 0.25 * all_pairs.value, (made.value, all_pairs.value)  # the queries fall into four clusters


def test_joined_groups():
    from chronoweave.llm.vector_topk import joined_groups

    at = np.array([0.0, 1.0, 10.0, 11.0, 30.0])
    got = joined_groups({0: 3, 1: 3, 2: 3, 3: 9, 4: 1}, np.abs(at[:, None] - at[None]), 6)
    assert got[0] == got[1] != got[2] == got[4] and got[3] not in (got[0], got[2])
