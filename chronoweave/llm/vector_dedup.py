"""Near-duplicate vectors through an inverted multi-index.

Each half of the vectors has a codebook of its own; a pair of codewords is a cell of
the product grid. A vector walks the cells from the nearest on (a multi-sequence
traversal of its two sorted lists of codewords, by a heap) and stops where the target
recall is reached. What the cells hold is verified by exact cosine, in blocks of
bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import BATCH_BYTES, column_of, map_arrow, map_batches, written
from chronoweave.llm.components import connected_components
from chronoweave.llm.vector_topk import _distances, _matrix, usable

#: Vectors that the codebooks are fitted on: at least, for each codeword, and bytes at most. A bounded sample by a hash of the id.
SAMPLE, PER_WORD, SAMPLE_BYTES = 4096, 16, 32 << 20
#: Vectors of a cell that meet in one task, and of a label's cell on average, about.
BLOCK, CELL = 2048, 32
#: Vectors whose walks are held at once.
WALKERS = 512
#: Codewords of a half at most; cells grow beyond WORDS ** 2 * CELL vectors of a label alone (some 500 million).
WORDS = 4096
#: A partner lies in any direction alike, so the part of its distance that leads to one cell is this many
#: standard deviations long at most; by the normal law fewer than one in a million partners lies beyond.
DEVIATIONS = 5.0


def codebook(half: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """k-means of one half, started from spread out points; the same input gives the same words."""
    half = np.unique(half, axis=0)
    words = min(words, len(half))
    at = [0]
    near = ((half - half[0]) ** 2).sum(axis=1)
    for _ in range(words - 1):
        at.append(int(np.argmax(near)))
        near = np.minimum(near, ((half - half[at[-1]]) ** 2).sum(axis=1))
    book = half[at]
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_distances(half[a : a + 4096], book), axis=1) for a in range(0, len(half), 4096)])
        size = np.bincount(own, minlength=words)
        sums = np.stack([np.bincount(own, half[:, j], words) for j in range(half.shape[1])], axis=1)
        book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
    return book


class MultiIndex:
    def __init__(self, sample: np.ndarray, words: int):
        self.cut = sample.shape[1] // 2
        self.books = [codebook(sample[:, : self.cut], words), codebook(sample[:, self.cut :], words)]
        self.between = [np.maximum(_distances(b, b), 1e-12) for b in self.books]

    def _to_words(self, unit: np.ndarray) -> list[np.ndarray]:
        return [_distances(h, b) for h, b in zip((unit[:, : self.cut], unit[:, self.cut :]), self.books, strict=True)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell of each vector."""
        one, two = (np.argmin(d, axis=1) for d in self._to_words(unit))
        return one * len(self.books[1]) + two

    def stop(self, radius: float, exact: bool = False) -> float:
        """How far beyond its own cell a vector walks for partners within radius.

        In few dimensions, and where the search is to be exact, it is the radius itself, and
        no partner is missed. Else partners whose difference lies along few directions may be.
        """
        return radius if exact else radius * min(1.0, DEVIATIONS / (2 * self.cut) ** 0.5)

    def visits(self, unit: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of the cells walked to, nearest first for each vector.

        A codeword's region is at least the distance to the bisector with the vector's
        own codeword away; a cell is as far as its two codewords' regions together.
        """
        low = []
        for d, between in zip(self._to_words(unit), self.between, strict=True):
            own = np.argmin(d, axis=1)
            least = d[np.arange(len(d)), own][:, None]
            far = (d * d - least * least) / (2 * between[own])
            far[np.arange(len(d)), own] = 0
            low.append(np.maximum(far, 0) ** 2)
        order = [np.argsort(x, axis=1, kind="stable") for x in low]
        near = [np.take_along_axis(x, o, axis=1) for x, o in zip(low, order, strict=True)]
        end = stop * stop
        # of either list, the codewords that can be reached at all
        reach = [(x <= end).sum(axis=1).tolist() for x in near]
        vectors, cells = [], []
        for v in range(len(unit)):
            one, two = near[0][v, : reach[0][v]].tolist(), near[1][v, : reach[1][v]].tolist()
            first, second = order[0][v], order[1][v]
            heap = [(one[0] + two[0], 0, 0)]
            while heap:
                far, i, j = heapq.heappop(heap)
                if far > end:
                    break
                vectors.append(v)
                cells.append(int(first[i]) * len(self.books[1]) + int(second[j]))
                # each pair of places has one before it: the same row, or the row above at its start
                if j + 1 < len(two):
                    heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(one):
                    heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
        return np.array(vectors, np.int64), np.array(cells, np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _verified(q: pa.Table, x: pa.Table, least: float) -> pa.Table:
    """Links between one block of visitors and one block of a cell, all of one label.

    Per visitor the vectors linked to it (all rows behind a class counted), and edges
    that join what is connected inside the block pair, one for each vector at most.
    """
    ids, weight, root = [np.empty(0, np.int64)] * 3
    if q.num_rows and x.num_rows:
        a, b = _matrix(q).astype(np.float64), _matrix(x).astype(np.float64)
        qi, xi, n = q.column("vec_id").to_numpy(), x.column("vec_id").to_numpy(), x.column("n").to_numpy()
        linked = (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]) >= least
        linked &= qi[:, None] != xi[None]
        counts = linked @ n
        left, right = np.full(len(qi), -1, np.int64), np.full(len(xi), -1, np.int64)
        for start in np.flatnonzero(linked.any(axis=1)).tolist():
            if left[start] >= 0:
                continue
            front = np.array([start])
            left[start] = qi[start]
            while len(front):
                new = linked[front].any(axis=0) & (right < 0)
                right[new] = qi[start]
                front = np.flatnonzero(linked[:, new].any(axis=1) & (left < 0)) if new.any() else np.empty(0, np.int64)
                left[front] = qi[start]
        some, reached = left >= 0, right >= 0
        ids = np.concatenate([qi[some], xi[reached]])
        weight = np.concatenate([counts[some], np.zeros(int(reached.sum()), np.int64)])
        root = np.concatenate([left[some], right[reached]])
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "links": pa.array(weight, pa.int64()), "root": pa.array(root, pa.int64())})


def near_duplicates(vectors: DataFrame, least: float = 0.98, words: int | None = None, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine at least `least` between vectors of one label, and their components.

    One row per row of vectors: vec_id, n_links (other rows linked to it), component_id
    (smallest vec_id reachable), kept (the component's own smallest). Null or zero
    vectors, those with null or non-finite components, rows without a label or an id and
    vectors of another length link with nothing. Identical vectors of one label are one
    class, so thousands of copies cost as much as one; each row of a repeated id counts by
    its own vector. Links found are exact; of the links there are, the index finds all if
    `exact`, which walks to several times as many cells, else all but
    a share set by DEVIATIONS (see the README for figures). Other columns, of any name, are not read.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("usable", usable(F.col("v")) & F.exists("v", lambda x: x != 0.0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = written(rows.withColumn("usable", F.coalesce("usable", F.lit(False))), "vectors")
    classes = written(rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vector-classes")

    # classes of the label that a class has, on average over the classes of a length
    held = classes.groupBy(F.size("v").alias("dim"), "label").agg(F.count("*").cast("double").alias("n")).groupBy("dim").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n"))
    parts = [_linked(classes.where(F.size("v") == r["dim"]), r["dim"], r["n"], least, words, exact) for r in held.collect()]
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = written(found, "vector-links")
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        parts_of = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
        known = classes.join(links, "vec_id", "left").join(parts_of.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    else:
        known = classes.select("label", "v", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where("usable").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(classes: DataFrame, dim: int, n: float, least: float, words: int | None, exact: bool) -> DataFrame:
    """vec_id, links, root of the classes of one vector length; n of them have a label on average.

    Only vectors of one label meet: each label has the cells of the grid to itself, so the grid is
    as fine as a label's vectors need and a vector visits no cell for other labels' sake.
    """
    spark = classes.sparkSession
    most = max(SAMPLE_BYTES // (8 * dim), 4)
    words = words or int(np.clip((n / CELL) ** 0.5, 4, min(WORDS, max(most // PER_WORD, 4))))
    sample = classes.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(max(SAMPLE, PER_WORD * words), most)).toPandas()["v"]
    index = MultiIndex(_unit(np.stack(sample.to_list())), words)
    sent = spark.sparkContext.broadcast(index)
    stop = index.stop(float(np.sqrt(2 - 2 * least)) * (1 + 1e-9) + 1e-9, exact)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = sent.value.cells(_unit(_matrix(batch)))
        return pa.record_batch([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def walks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        unit = _unit(_matrix(batch))
        for a in range(0, len(unit), WALKERS):
            r, c = sent.value.visits(unit[a : a + WALKERS], stop)
            yield r + a, c

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a vector is repeated for each of its cells: what leaves at once is bounded, however many these are
        rows = max(BATCH_BYTES // (8 * dim + 64), 1)
        for batch in batches:
            for r, c in walks(batch) if batch.num_rows else ():
                for a in range(0, len(r), rows):
                    at = pa.array(r[a : a + rows])
                    yield pa.record_batch([*(x.take(at) for x in batch.columns), pa.array(c[a : a + rows])], [*batch.schema.names, "cell"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, c in walks(batch) if batch.num_rows else ():
                both = pa.table({"label": column_of(batch, "label").take(pa.array(r)), "cell": c}).group_by(["label", "cell"]).aggregate([([], "count_all")])
                yield from both.select(["label", "cell", "count_all"]).rename_columns(["label", "cell", "visits"]).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", cell long"
    data, visitors = map_arrow(classes, place, schema), map_batches(classes, visit, schema)
    cell = ["label", "cell"]
    held = data.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("held"))
    come = map_batches(classes, count, "label string, cell long, visits long").groupBy(cell).agg(F.ceil(F.sum("visits") / BLOCK).cast("int").alias("come"))
    sizes = written(come.join(held, cell), "vector-cells")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visitors.join(sizes, cell).withColumn("a", own("come")).withColumn("b", every("held"))
    right = data.join(sizes, cell).withColumn("b", own("held")).withColumn("a", every("come"))
    key = [*cell, "a", "b"]
    pairs = left.select(*key, "vec_id", "n", "v").groupBy(key).cogroup(right.select(*key, "vec_id", "n", "v").groupBy(key))
    return pairs.applyInArrow(lambda q, x: _verified(q, x, least), "vec_id long, links long, root long")
