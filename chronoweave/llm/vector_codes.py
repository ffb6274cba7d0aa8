"""Product codes of vectors, by a Lloyd iteration that keeps parts in heaps.

Vectors are cut into equal parts; each part position has a codebook. A block of vectors
keeps, for each position and each entry of its codebook, a heap of the parts assigned to
the entry. A part's key is the slack between its lower bound (the distance of the next
nearest entry) and its upper bound (that of its own) when it was last scanned, plus the
drift of its entry so far. While the entry's drift stays below the key, no other entry
can be nearer; so a round pops only the heap tops that the drift has reached, scans those
parts exactly and pushes them again. Parts that changed their entry are summed in their
block; the sums of all blocks move the entries.

Everything that decides is in whole numbers. Only the bounds are in doubles, and they are
widened by more than their rounding.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch, column_of, map_arrow, map_batches, with_groups
from chronoweave.llm.quality_rules import group_key
from chronoweave.llm.vector_topk import usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, about, and parts that are scanned at once.
BLOCK, SCAN = 8192, 2048
#: Components beyond this size (after scaling) are held at it.
LARGEST = 1 << 26

_BLOCK = "ids array<long>, labels array<string>, vectors binary, own binary, sizes binary, keys binary, members binary"
_MOVED = "moved array<struct<part:int,entry:int,sums:array<bigint>>>"


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) ** 2 * 4 * x.shape[1] < 1 << 53:  # doubles hold every step
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - book[None, :, j]) ** 2
    return out


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and the slack: how much farther the next nearest is."""
    own, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), SCAN):
        d = squared(x[a : a + SCAN], book)
        at = np.arange(len(d))
        own[a : a + SCAN] = best = d.argmin(axis=1)
        upper = np.sqrt(d[at, best])
        d[at, best] = np.iinfo(np.int64).max
        slack[a : a + SCAN] = np.sqrt(d.min(axis=1)) - upper
    return own, slack


class Heaps:
    """The heaps of one part position in a block, one for each entry, held one after the other."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, members: np.ndarray):
        self.sizes, self.keys, self.members = sizes, keys, members

    @classmethod
    def built(cls, own: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        """In order of their keys, which is a heap."""
        order = np.lexsort((keys, own))
        return cls(np.bincount(own, minlength=entries), keys[order], order)

    def rescanned(self, x: np.ndarray, own: np.ndarray, book: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Pops what the drift has reached, scans it and pushes it again; own changes in place. The members popped."""
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        tops = np.where(self.sizes > 0, self.keys[np.minimum(starts[:-1], max(len(self.keys) - 1, 0))], np.inf) if len(self.keys) else np.full(len(self.sizes), np.inf)
        heaps, popped = {}, []

        def opened(entry: int) -> list[tuple[float, int]]:
            if entry not in heaps:
                a, b = starts[entry], starts[entry + 1]
                heaps[entry] = list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist(), strict=True))
            return heaps[entry]

        for entry in np.flatnonzero(tops <= drift).tolist():
            heap, reached = opened(entry), drift[entry]
            while heap and heap[0][0] <= reached:
                popped.append(heapq.heappop(heap)[1])
        popped = np.array(popped, np.int64)
        if len(popped):
            own[popped], slack = scanned(x[popped], book)
            for entry, key, member in zip(own[popped].tolist(), (slack + drift[own[popped]]).tolist(), popped.tolist(), strict=True):
                heapq.heappush(opened(entry), (key, member))
            kept = [heaps.get(e) for e in range(len(self.sizes))]
            self.keys = np.concatenate([self.keys[starts[e] : starts[e + 1]] if h is None else np.array([k for k, _ in h]) for e, h in enumerate(kept)])
            self.members = np.concatenate([self.members[starts[e] : starts[e + 1]] if h is None else np.array([m for _, m in h], np.int64) for e, h in enumerate(kept)])
            self.sizes = np.array([starts[e + 1] - starts[e] if h is None else len(h) for e, h in enumerate(kept)])
        return popped


class Codebooks:
    """Entries of all part positions, sums and counts of the parts assigned to them, and their drift so far."""

    def __init__(self, first: np.ndarray):
        self.entries = first  # (parts, entries, width)
        self.sums = np.zeros((*first.shape[:2], first.shape[2] + 1), np.int64)
        self.drift = np.zeros(first.shape[:2])

    def moved(self, rows: list) -> None:
        """Adds what the blocks have summed, and moves each entry to the floor of its parts' mean."""
        for r in rows:
            self.sums[r.part, r.entry] += np.array(r.sums)
        count = self.sums[:, :, -1:]
        new = np.where(count > 0, self.sums[:, :, :-1] // np.maximum(count, 1), self.entries)
        for part, (old, book) in enumerate(zip(self.entries, new, strict=True)):
            own = np.sqrt(((old - book) ** 2).sum(axis=1).astype(np.float64))
            farthest = np.sort(own)[::-1]
            others = np.where(own == farthest[0], farthest[min(1, len(farthest) - 1)], farthest[0])
            self.drift[part] += (own + others) * (1 + 1e-9) + 1e-6
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _packed(lists: list[np.ndarray], kind: str) -> bytes:
    return np.concatenate(lists).astype(kind).tobytes()


def _read(batch: pa.RecordBatch, row: int, parts: int) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    """Vectors (vectors, parts, width), own entries (parts, vectors) and heaps of a block."""
    get = lambda c, kind: np.frombuffer(column_of(batch, c)[row].as_py(), kind)
    n = len(column_of(batch, "ids")[row])
    x = get("vectors", "<i4").reshape(n, parts, -1).astype(np.int64)
    own = get("own", "<i4").reshape(parts, n).astype(np.int64)
    sizes, keys, members = get("sizes", "<i4").reshape(parts, -1).astype(np.int64), get("keys", "<f8").reshape(parts, n), get("members", "<i4").reshape(parts, n).astype(np.int64)
    return x, own, [Heaps(*x) for x in zip(sizes, keys, members, strict=True)]


def _row(ids: list, labels: list, x: np.ndarray, own: np.ndarray, heaps: list[Heaps], changed: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """A block to write: changed has for each part the members whose sums change, and their entries before (none: -1)."""
    moved = []
    for part, (at, before) in enumerate(changed):
        width = x.shape[2]
        entries = len(heaps[part].sizes)
        sums = np.zeros((entries, width + 1), np.int64)
        ones = np.concatenate([x[at, part], np.ones((len(at), 1), np.int64)], axis=1)
        np.add.at(sums, own[part][at], ones)
        left = before >= 0
        np.add.at(sums, before[left], -ones[left])
        moved += [{"part": part, "entry": e, "sums": sums[e].tolist()} for e in np.flatnonzero(sums.any(axis=1)).tolist()]
    return {
        "ids": ids, "labels": labels, "vectors": x.astype("<i4").tobytes(), "own": _packed(list(own), "<i4"), "sizes": _packed([h.sizes for h in heaps], "<i4"),
        "keys": _packed([h.keys for h in heaps], "<f8"), "members": _packed([h.members for h in heaps], "<i4"), "moved": moved,
    }


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *((c, pa.binary()) for c in ("vectors", "own", "sizes", "keys", "members")), ("moved", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])))])


def _first_blocks(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks of vectors, each part scanned once and put into the heap of its nearest entry."""
    entries = books.entries

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = column_of(part, "v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, len(entries), -1)
                found = [scanned(x[:, p], entries[p]) for p in range(len(entries))]
                own = np.stack([o for o, _ in found])
                heaps = [Heaps.built(o, s, entries.shape[1]) for o, s in found]
                every = np.arange(len(x))
                row = _row(column_of(part, "vec_id").to_pylist(), column_of(part, "label").to_pylist(), x, own, heaps, [(every, np.full(len(x), -1))] * len(entries))
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return map_batches(rows, one, f"{_BLOCK}, {_MOVED}")


def _next_blocks(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks after a round: what the drift has reached is scanned again."""
    entries, drift = books.entries, books.drift

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in range(batch.num_rows):
            x, own, heaps = _read(batch, r, len(entries))
            changed = []
            for p, heap in enumerate(heaps):
                before = own[p].copy()
                heap.rescanned(x[:, p], own[p], entries[p], drift[p])
                at = np.flatnonzero(before != own[p])
                changed.append((at, before[at]))
            rows.append(_row(column_of(batch, "ids")[r].as_py(), column_of(batch, "labels")[r].as_py(), x, own, heaps, changed))
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_arrow(blocks.drop("moved"), one, f"{_BLOCK}, {_MOVED}")


def _coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of the vectors of blocks."""
    entries = books.entries

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in range(batch.num_rows):
            x, own, _ = _read(batch, r, len(entries))
            error = sum(((x[:, p] - entries[p][own[p]]) ** 2).sum(axis=1) for p in range(len(entries)))
            code = ["".join(f"{e:02x}" for e in c) for c in own.T.tolist()]
            yield pa.record_batch([column_of(batch, "ids")[r].values, column_of(batch, "labels")[r].values, pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from one(batch)

    return map_batches(blocks, every, "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Product codes of all usable vectors: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x); each codebook starts as that part of the first
    `entries` vectors by id (and by components, where ids are equal; a null id last), fewer
    if there are fewer. `rounds` times every part goes to its nearest entry, ties to the lower
    index, and entries move to the floor of their parts' mean; then parts are assigned
    again. code has two hex digits for each part (so entries is 256 at most), error the
    squared distances of its parts, label_error the errors of all vectors of the label
    (nulls together), codebooks_sha256 the final entries' components, decimal and
    comma-joined.

    Rows whose vector is null, empty or holds a null or non-finite component are left out.
    The length is that of the first usable vector whose length the parts divide; vectors
    of another length have null code and error. Components of more than LARGEST in size
    after scaling are held at it, so that squares fit 64 bits. Repeated rows and ids count
    as rows of their own. An empty table gives an empty table. Other columns, of any name,
    are not read.

    A round reads and writes the blocks once and shuffles sums by entry alone; the driver
    holds the codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    v = F.col(vector_col)
    held = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int")
    rows = vectors.where(usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(v, held).alias("v"))
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = rows.where(F.size("v") % parts == 0).orderBy(*order).limit(1).select(F.size("v")).first()
    size = first[0] if first else 0
    fit = rows.where(F.size("v") == size)
    start = np.array([r.v for r in fit.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    if not len(start):
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.selectExpr("vec_id", "cast(null as string) code", "cast(null as long) error", "cast(null as long) label_error", "cast(null as string) codebooks_sha256") if not rows.isEmpty() else spark.createDataFrame([], empty)

    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    width = size // parts
    blocks = scratch.write(_first_blocks(fit, books), "blocks")
    for _ in range(rounds):
        moved = blocks.select(F.explode("moved").alias("m")).groupBy("m.part", "m.entry").agg(F.array(*[F.sum(F.col("m.sums")[j]) for j in range(width + 1)]).alias("sums"))
        books.moved(moved.collect())  # a row for each entry
        blocks = scratch.write(_next_blocks(blocks, books), "blocks")
    coded = _coded(blocks, books).unionByName(rows.where(F.size("v") != size).selectExpr("vec_id", "label", "cast(null as string) code", "cast(null as long) error"))
    coded = scratch.write(coded.withColumn("label", group_key(F.col("label"))), "coded")
    labels = scratch.write(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")), "labels")
    found = with_groups(coded, labels, ["label"], "held")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
