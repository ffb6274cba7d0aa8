"""Exact top-k inner product search as a Voronoi kNN join.

Vectors are lifted by one coordinate so that all have the same length; then the
largest inner products are the smallest distances. Queries and vectors are grouped by
their nearest pivot. Summaries of the groups give each query group a bound on the
distance of its k-th neighbour; neighbouring query groups join up to a block's size, and
a vector is sent once to each of the joined groups that it may still concern. What
meets is searched in blocks of bounded size, and the blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import column_of, map_arrow, written

#: Pivots at least and at most, and queries for each; vectors and queries in a block. What a task holds is bounded by them.
PIVOTS, MOST_PIVOTS, PIVOT_QUERIES = 32, 1024, 64
DATA_BLOCK, QUERY_BLOCK = 8192, 4096

_ROW = "vec_id long, dim int, v array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, v: usable vectors as floor(scale * x)."""
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).distinct()


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lifted(v: np.ndarray, top: float, data: bool) -> np.ndarray:
    """Vectors with one more coordinate; for data it fills their length up to top, for queries it is 0."""
    x = v.astype(np.float64)
    extra = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
    return np.hstack([x, extra[:, None]])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def _assigned(rows: DataFrame, pivots: np.ndarray, top: float, data: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = _distances(_lifted(_matrix(batch), top, data), sent.value)
        near = np.argmin(d, axis=1)
        return pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], [*batch.schema.names, "cell", "d"])

    return map_arrow(rows, assign, f"{_ROW}, cell int, d double")


def _nearest_of_cells(data: DataFrame, k: int) -> DataFrame:
    """The k smallest distances to each cell's pivot: cut in every batch, then over all."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, d = column_of(batch, "cell").to_numpy(), column_of(batch, "d").to_numpy()
        order = np.lexsort((d, cell))
        first = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        keep = order[place < k]
        return pa.record_batch([pa.array(cell[keep]), pa.array(d[keep])], ["cell", "d"])

    near = map_arrow(data.select("cell", "d"), cut, "cell int, d double")
    return near.withColumn("n", F.row_number().over(W.partitionBy("cell").orderBy("d"))).where(F.col("n") <= k).select("cell", "d")


def _concerns(part: int, limit: float, radius: float, between: np.ndarray, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which vectors (their cells and distances to these pivots) may be among the best of a query group."""
    # distances carry rounding errors far below a millionth of their size
    return between[part][cell] - radius - d <= limit + 1e-6 * (1 + between[part][cell] + radius + d)


def _best(queries: pa.Table, data: pa.Table, k: int, bounds: dict[int, tuple[float, float]], between: np.ndarray) -> pa.Table:
    """The k best vectors of one block for each query of one block.

    Each query group is multiplied by the vectors alone that its own bound leaves.
    """
    out = [np.empty(0, np.int64)] * 3
    if queries.num_rows and data.num_rows:
        ids = data.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        every, v = ids[order], _matrix(data)[order]
        cell, d = data.column("cell").to_numpy()[order], data.column("d").to_numpy()[order]
        q, asked, parts = _matrix(queries), queries.column("vec_id").to_numpy(), queries.column("part").to_numpy()
        exact = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**53
        wide = v.astype(np.float64) if exact else v
        found = []
        for p in np.unique(parts).tolist():
            left = _concerns(p, *bounds[p], between, cell, d)
            if not left.any():
                continue
            ids, x = (every, wide) if left.all() else (every[left], wide[left])
            mine = np.flatnonzero(parts == p)
            for a in range(0, len(mine), 256):
                part, own = q[mine[a : a + 256]], asked[mine[a : a + 256]]
                score = (part.astype(np.float64) @ x.T).astype(np.int64) if exact else part @ x.T
                for i, row in enumerate(score):
                    allowed = ids != own[i]
                    row = np.where(allowed, row, np.iinfo(np.int64).min)
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else row.min()
                    take = np.flatnonzero((row >= least) & allowed)
                    take = take[np.lexsort((ids[take], -row[take]))[:k]]
                    found.append((np.full(len(take), own[i]), ids[take], row[take]))
        if found:
            out = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})


def joined_groups(sizes: dict[int, int], between: np.ndarray, most: int) -> dict[int, int]:
    """Query groups put together, neighbours first, while they hold no more than `most` queries: group to joined group."""
    left, out, number = set(sizes), {}, 0
    while left:
        at = min(left)
        room = most
        while at is not None:
            left.discard(at)
            out[at] = number
            room -= sizes[at]
            fits = [j for j in left if sizes[j] <= room]
            at = min(fits, key=lambda j: (between[at, j], j)) if fits else None
        number += 1
    return out


def _one_dimension(data: DataFrame, queries: DataFrame, n: int, top: float, k: int, pivots: int | None) -> DataFrame:
    spark = data.sparkSession
    pivots = pivots or int(np.clip(queries.count() // PIVOT_QUERIES, PIVOTS, MOST_PIVOTS))
    chosen = data.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(pivots, n)).toPandas()["v"]
    points = _lifted(np.stack(chosen.to_list()), top, True)
    data = written(_assigned(data, points, top, True), "topk-data")
    queries = written(_assigned(queries, points, top, False), "topk-queries")

    # summaries: a row for each pivot, and k + 1 distances (a query may meet itself)
    count = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    reach = {r["cell"]: (r["d"], r["n"]) for r in queries.groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()}
    if not reach:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    near = _nearest_of_cells(data, k + 1).collect()
    between = _distances(points, points)
    limits, splits = {}, {}
    cells, d_near = np.array([r["cell"] for r in near]), np.array([r["d"] for r in near])
    group = joined_groups({i: q for i, (_, q) in reach.items()}, between, QUERY_BLOCK)
    for i, (radius, _) in reach.items():
        upper = np.sort(radius + between[i, cells] + d_near)
        limits.setdefault(group[i], []).append((i, float(upper[k]) if len(upper) > k else np.inf, radius))
    for g, own in limits.items():
        splits[g] = (-(-sum(count.values()) // DATA_BLOCK), -(-sum(reach[i][1] for i, _, _ in own) // QUERY_BLOCK))
    sent = spark.sparkContext.broadcast((limits, splits, between, group))

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A vector goes to the joined groups of which it may concern a part, to one block, for all query blocks."""
        limits, splits, between, _ = sent.value
        cell, d, ids = column_of(batch, "cell").to_numpy(), column_of(batch, "d").to_numpy(), column_of(batch, "vec_id").to_numpy()
        rows, keys = [], []
        for i, own in limits.items():
            needed = np.zeros(len(cell), bool)
            for part, limit, radius in own:
                needed |= _concerns(part, limit, radius, between, cell, d)
            hit = np.flatnonzero(needed)
            blocks, query_blocks = splits[i]
            block = (ids[hit].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
            for b in range(query_blocks):
                rows.append(hit)
                keys.append((np.full(len(hit), i, np.int64) << 40) | (block.astype(np.int64) << 20) | b)
        rows, keys = np.concatenate(rows), np.concatenate(keys)
        return pa.record_batch([pa.array(keys), *(column_of(batch, c).take(pa.array(rows)) for c in ("vec_id", "cell", "d", "v"))], ["key", "vec_id", "cell", "d", "v"])

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """A query goes to one block of its joined group, for all vector blocks."""
        _, splits, _, group = sent.value
        cell, ids = [group[c] for c in column_of(batch, "cell").to_pylist()], column_of(batch, "vec_id").to_pylist()
        pairs = [(r, (c << 40) | (b << 20) | ((v * 0x9E3779B1 >> 7) % splits[c][1])) for r, (c, v) in enumerate(zip(cell, ids, strict=True)) for b in range(splits[c][0])]
        rows = pa.array([p[0] for p in pairs])
        return pa.record_batch([pa.array([p[1] for p in pairs], pa.int64()), *(column_of(batch, c).take(rows) for c in ("vec_id", "cell", "v"))], ["key", "vec_id", "part", "v"])

    def searched(q: pa.Table, x: pa.Table) -> pa.Table:
        limits, _, between, _ = sent.value
        return _best(q, x, k, {part: (limit, radius) for own in limits.values() for part, limit, radius in own}, between)

    left, right = map_arrow(queries, spread, "key long, vec_id long, part int, v array<long>"), map_arrow(data, route, "key long, vec_id long, cell int, d double, v array<long>")
    return left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(searched, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of highest integer inner product for each query, exactly.

    vectors: all rows, queries among them where is_query holds. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id, fewer rows if there are
    fewer vectors. Null vectors, and those with null or non-finite components, and rows
    without an id take no part; identical rows count once, a repeated id with different
    vectors once for each of them, as query and as candidate (never as its own); only
    vectors of the query's own length are its candidates. An empty table gives an empty result.
    """
    rows = written(quantised(vectors, scale, id_col, vector_col), "topk-rows")
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    parts = []
    for r in rows.groupBy("dim").agg(F.max(norm).alias("top"), F.count("*").alias("n")).collect():  # a row for each vector length
        own = rows.where(F.col("dim") == r["dim"])
        parts.append(_one_dimension(own, own.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id"), r["n"], r["top"], k, pivots))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
