"""N-gram Jaccard join as a blocked product of the document by n-gram incidence.

A document is the set of its word shingles. Documents with one set are one class, and
classes are the rows of the incidence matrix. Only the columns that a pair above the
threshold must share are multiplied: of each row the few shingles that come first in an
order by rarity. The product is summed per pair, pairs whose overlap cannot reach the
bound that their sizes give are discarded, and the rest is counted on whole sets.

Large groups of near copies never expand into all their pairs. In the first products
each column meets only one of its rows; what that links is contracted, columns that
hold one component alone drop out, and the next product meets another row. The last
product pairs all rows that are still of different components, in blocks: the pairs of
one column spread over as many tasks as it has pairs of blocks. A sketch of each set
gives an upper bound of a pair's overlap before whole sets are compared.

Before any product the whole matrix passes the shuffle once, compressed, to count for
each row the columns that it shares with any other; rows that share too few for a link
are left out. Texts are read twice, the second time those of rows that are left.
Intermediate tables go as soon as the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronoweave.llm.common import Scratch, column_of, map_arrow, map_batches, partial_batch, small, texts_of
from chronoweave.llm.components import connected_components

#: Shingles in so many documents or more count as common; the most common of them, at most, are ordered last.
COMMON_FROM = 48
COMMON_KEPT = 100_000
#: Contracting products at most, and the share of the rows still apart that one must link for another to follow.
ROUNDS, GOES_ON = 4, 0.02
#: Rows of a column that form a block of the last product.
BLOCK = 256
#: Hashes that a task gathers before it sends them on.
GATHER = 1 << 21
#: Bits of a set's sketch, in words of 64.
SKETCH_WORDS = 8
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]

#: ASCII letters lowered; all other bytes as they are.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, an odd base's inverse, its powers' seed: the same everywhere."""
    rng = np.random.default_rng(7)
    base = int(rng.integers(1 << 62)) | 1
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base (or of its inverse) modulo 2**64."""
    held = _powers.get(kind)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = np.full(size, _tables()[1] if kind == "base" else _tables()[2], np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            held = _powers[kind] = np.multiply.accumulate(base)
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles.

    A text with fewer words than width has its whole sequence as one shingle, one
    without words has none. All substrings are hashed at once, by differences of a
    running sum of the bytes times powers of a base.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(width, len(words))
    first, last = starts[: len(words) - n + 1], ends[n - 1 :]
    letters = _tables()[0]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters[data] * _power("base", len(data)), dtype=np.uint64)])
        hashes = (sums[last] - sums[first]) * _power("inverse", len(data) + 1)[first] + (last - first).astype(np.uint64)
    return np.unique(mixed(hashes))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *[a.view(np.int64) for a in arrays]])))


def digests(h: np.ndarray) -> bytes:
    """128 bits of a set of hashes, and its size."""
    with np.errstate(over="ignore"):
        one, two = (np.add.reduce(mixed(x), dtype=np.uint64) for x in (h + np.uint64(1), h ^ np.uint64(0x5851F42D4C957F2D)))
    return np.array([one, two, len(h)], np.uint64).tobytes()


def sketch(h: np.ndarray) -> bytes:
    """A bit for each part of the hash space: the parity of the set's hashes there.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    bits = 64 * SKETCH_WORDS
    return np.packbits((np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


#: Shingles of a part of the hash space, about: what a task holds of it is bounded, whatever the input.
PART_SHINGLES = 1 << 20


def _part_bits(rows: DataFrame) -> int:
    """Parts of the hash space in bits, by the texts' length at about six characters a word."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(4, (chars // (6 * PART_SHINGLES)).bit_length())


def _packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed run; ascending ones should come as differences."""
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    raw = b"".join([sizes.tobytes(), *[a.tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(run: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(run[8:], int.from_bytes(run[:8], "little"), "zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_FIRST = pa.schema([("part", pa.int64()), ("base", pa.int64()), ("run", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_SEEN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("base", pa.int64()), ("counts", pa.binary()), ("key", pa.int64()), ("df", pa.int64())])
#: Rows that a task numbers from one base, at most, in bits.
_ROW_BITS = 20


def _incidence(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """The whole incidence matrix, compressed, dealt to parts of the hash space.

    part, base, run: the hashes in a part of the rows from base on, ascending, and each
    one's row. part, row, doc_id, n, h1, h2: the digest of every document; parts from
    2 ** bits on hold these. Of equal sets that a task meets together one is in the runs.
    """
    parts = 1 << bits

    def runs(held: list[np.ndarray], at: list[int], base: int) -> pa.RecordBatch:
        col = np.concatenate(held) >> np.uint64(32 - bits)
        row = np.repeat(np.array(at, np.uint32), [len(h) for h in held])
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        cuts = np.searchsorted(col, np.arange(1, parts, dtype=np.uint64) << np.uint64(32))
        each = zip(np.split(col, cuts), np.split(row, cuts), strict=True)
        blobs = [(k, _packed(np.diff(x.astype(np.uint32), prepend=np.uint32(0)), y)) for k, (x, y) in enumerate(each) if len(x)]
        return partial_batch(_FIRST, part=pa.array([k for k, _ in blobs]), base=pa.array(np.full(len(blobs), base)), run=pa.array([b for _, b in blobs], pa.binary()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        base, rows, size = task << 40, 0, 0
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        at: list[int] = []
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in texts_of(batch)]
            keys = [digests(h) for h in sets]
            got = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 3)
            digest = {name: pa.array(np.ascontiguousarray(got[:, k])) for k, name in enumerate(("h1", "h2", "n"))}
            part = pa.array(np.full(len(sets), parts + task % parts))
            yield partial_batch(_FIRST, part=part, row=pa.array(np.arange(base + rows, base + rows + len(sets))), doc_id=column_of(batch, "doc_id"), **digest)
            for k, (h, key) in enumerate(zip(sets, keys, strict=True)):
                if len(h) and key not in seen:
                    seen.add(key)
                    held.append(h)
                    at.append(rows + k)
                    size += len(h)
            rows += len(sets)
            if size >= GATHER or rows >= 1 << (_ROW_BITS - 1):
                if held:
                    yield runs(held, at, base)
                base, rows, size, seen, held, at = base + (1 << _ROW_BITS), 0, 0, set(), [], []
        if held:
            yield runs(held, at, base)

    return map_batches(docs, read, "part long, base long, run binary, row long, doc_id long, n long, h1 long, h2 long")


def _met(first: DataFrame, bits: int) -> DataFrame:
    """What the parts show: the digests as they are, how many shingles of each row others have too, and common shingles.

    base, counts: for the rows from base on, the number of their shingles in one part
    that two rows or more share. key, df: leading bits of a shingle that COMMON_FROM
    rows or more have, and how many.
    """
    parts = 1 << bits

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.combine_chunks()
        if part >= parts:
            rows = {x: table.column(x).combine_chunks() for x in ("row", "doc_id", "n", "h1", "h2")}
            return pa.Table.from_batches([partial_batch(_SEEN, **rows)])
        held = [_unpacked(run.as_py(), np.uint32, np.uint32) for run in table.column("run")]
        col = np.concatenate([np.cumsum(c, dtype=np.uint32) for c, _ in held])
        source = np.repeat(np.arange(len(held)), [len(r) for _, r in held])
        cell = (source << _ROW_BITS) | np.concatenate([r for _, r in held])
        order = np.argsort(col, kind="stable")
        col, cell = col[order], cell[order]
        new = np.concatenate([[True], col[1:] != col[:-1]])
        run = np.cumsum(new) - 1
        df = np.bincount(run)
        cells, counts = np.unique(cell[df[run] > 1], return_counts=True)
        cuts = np.searchsorted(cells, np.arange(1, len(held)) << _ROW_BITS)
        each = zip(table.column("base").to_pylist(), np.split(cells & ((1 << _ROW_BITS) - 1), cuts), np.split(counts, cuts), strict=True)
        blobs = [(base, _packed(x.astype(np.uint32), y.astype(np.uint32))) for base, x, y in each if len(x)]
        often = df >= COMMON_FROM
        keys = (part << 32) | col[new][often].astype(np.int64)
        out = [partial_batch(_SEEN, base=pa.array([b for b, _ in blobs], pa.int64()), counts=pa.array([x for _, x in blobs], pa.binary()))]
        return pa.Table.from_batches([*out, partial_batch(_SEEN, key=pa.array(keys), df=pa.array(df[often]))])

    return first.groupBy("part").applyInArrow(meet, "row long, doc_id long, n long, h1 long, h2 long, base long, counts binary, key long, df long")


def _shared_counts(seen: DataFrame) -> DataFrame:
    """row, shared: how many of its shingles other rows have too, over all parts."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << _ROW_BITS, np.int64)
        for blob in table.column("counts"):
            row, count = _unpacked(blob.as_py(), np.uint32, np.uint32)
            total[row] += count
        some = np.flatnonzero(total)
        return pa.table({"row": pa.array(table.column("base")[0].as_py() + some), "shared": pa.array(total[some])})

    return seen.where("base is not null").select("base", "counts").groupBy("base").applyInArrow(add, "row long, shared long")


def _common(seen: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most common shingles: their hashes' leading bits, sorted, document counts, and the shift to those bits."""
    top = seen.where("key is not null").select("key", "df").orderBy(F.desc("df"), "key").limit(COMMON_KEPT).toPandas().sort_values("key")
    return top["key"].to_numpy(np.uint64), top["df"].to_numpy(np.int64), 32 - bits


def _prefix(h: np.ndarray, t: int, common: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The shingles that a partner must share one of, rarest first."""
    keys, counts, shift = common
    n = len(h)
    if n and len(keys):
        short = h >> np.uint64(shift)
        at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
        h = h[np.lexsort((h, np.where(keys[at] == short, counts[at], 0)))]
    # a partner has t/100 of the shingles at least, so it has one of the first of them
    return h[: n - -(-t * n // 100) + 1] if n else h


def _several(cells: DataFrame) -> DataFrame:
    """The cells of columns that several components share."""
    shared = cells.groupBy("col").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    return cells.join(shared.select("col"), "col", "left_semi")


def _candidate_sets(known: DataFrame, wanted: DataFrame, width: int, t: int, common: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """cid, n, cols, prefix and SKETCH of the wanted classes, from a text of each.

    wanted: cid, rep, n, h1, h2, written. An id of several texts gives the class its own text.
    """
    sent = known.sparkSession.sparkContext.broadcast(common)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(x, width) for x in texts_of(batch)]
        got = np.frombuffer(b"".join([digests(h) + sketch(h) for h in sets]), np.int64).reshape(-1, 3 + SKETCH_WORDS)
        columns = [pa.array(np.ascontiguousarray(got[:, k])) for k in range(got.shape[1])]
        prefixes = _lists([_prefix(h, t, sent.value) for h in sets])
        return pa.record_batch([column_of(batch, "doc_id"), _lists(sets), prefixes, *columns], ["rep", "cols", "prefix", "h1", "h2", "n", *SKETCH])

    texts = known.join(small(wanted.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    found = map_arrow(texts.select("doc_id", "text"), whole, "rep long, cols array<long>, prefix array<long>, h1 long, h2 long, n long, " + ", ".join(f"{c} long" for c in SKETCH))
    return found.join(wanted, ["rep", "n", "h1", "h2"]).groupBy("cid", "n").agg(*(F.first(c).alias(c) for c in ("cols", "prefix", *SKETCH)))


def _verified(sets: DataFrame, pairs: DataFrame, t: int) -> DataFrame:
    """u, v of the pairs (u, nu, v, nv; written) whose whole sets reach the threshold."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    some = sets.select("cid", "cols").join(needed, "cid", "left_semi")
    both = pairs.join(some.withColumnsRenamed({"cid": "u", "cols": "cu"}), "u").join(some.withColumnsRenamed({"cid": "v", "cols": "cv"}), "v")
    shared = F.size(F.array_intersect("cu", "cv"))
    return both.withColumn("shared", shared).where(f"100 * shared >= {t} * (nu + nv - shared)").select("u", "v")


def _products(left: DataFrame, right: DataFrame, t: int, on: list[str]) -> DataFrame:
    """Pairs of different components with the overlap of their prefixes, cut by the bound that their sizes give.

    left, right: col, cid, n, pos (the column's place in the row's order), comp. With
    blocks in `on`, both sides hold all rows with their sketches, and each pair comes once.
    """
    a, b = left.alias("a"), right.alias("b")
    fits = (F.col("a.n") * 100 >= F.col("b.n") * t) & (F.col("b.n") * 100 >= F.col("a.n") * t)
    # what can still be shared after this column, and at most all that came before it
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) + F.least("a.pos", "b.pos")
    bound = F.ceil(F.lit(t) * (F.col("a.n") + F.col("b.n")) / (100 + t))
    keep = F.col("a.comp") != F.col("b.comp")
    for c in on:
        keep &= F.col(f"a.{c}") == F.col(f"b.{c}")
    once = len(on) > 1
    if once:
        differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCH), F.lit(0))
        shared = (F.col("a.n") + F.col("b.n") - differ) / 2
        keep &= (F.col("a.cid") < F.col("b.cid")) & ((100 + t) * shared >= t * (F.col("a.n") + F.col("b.n")))
    met = a.join(b, keep & fits & (room >= bound))
    met = met.select(F.col("a.cid").alias("u"), F.col("a.n").alias("nu"), F.col("b.cid").alias("v"), F.col("b.n").alias("nv"), F.col("a.pos").alias("pu"), F.col("b.pos").alias("pv"))
    met = met.groupBy("u", "nu", "v", "nv").agg(F.count("*").alias("shared"), F.max("pu").alias("pu"), F.max("pv").alias("pv"))
    # the prefixes' shared columns, and after the last of them what the shorter rest holds
    need = F.ceil(F.lit(t) * (F.col("nu") + F.col("nv")) / (100 + t))
    met = met.where(F.col("shared") + F.least(F.col("nu") - F.col("pu") - 1, F.col("nv") - F.col("pv") - 1) >= need)
    if not once:
        return met
    # all but n - need of a set's shingles are shared, so that many of its prefix are, and
    # the k-th shared one lies among the first k + n - need of either set
    prefix = lambda n: n - F.ceil(F.lit(t) * n / 100) + 1
    return met.where(F.col("shared") >= need + F.least(prefix(F.col("nu")) - F.col("nu"), prefix(F.col("nv")) - F.col("nv")))


def _blocked(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the last product: each row of a column stands in its own block, before all blocks of the other side."""
    blocks = cells.groupBy("col").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = cells.join(blocks, "col").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("i", F.col("own")).withColumn("j", every), rows.withColumn("i", every).withColumn("j", F.col("own"))


def _classes(rows: DataFrame, t: int, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, h1, h2) of all rows; and (cid, n, h1, h2, rep, root) of the classes of rows with an id.

    rep is a class's smallest id, root the cid of its component's smallest class.
    """
    bits = _part_bits(rows)
    seen = scratch.write(_met(_incidence(rows, width, bits), bits), "seen")
    ids = scratch.write(seen.where("n is not null").select("row", "doc_id", "n", "h1", "h2"), "ids")
    common, shared = _common(seen, bits), scratch.write(_shared_counts(seen), "shared")
    scratch.drop("seen")
    filled = ids.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.write(classes.select("cid", "n", "h1", "h2", "rep"), "classes")

    # a link takes t/100 of a set's shingles, so that many must be in other sets at all
    wanted = ids.where("n > 0").join(shared, "row").where(f"100 * shared >= {t} * n").select("n", "h1", "h2").distinct().join(classes, ["n", "h1", "h2"])
    wanted = scratch.write(wanted, "wanted")
    sets = scratch.write(_candidate_sets(rows.where("doc_id is not null"), wanted, width, t, common), "sets")
    cells = sets.select("cid", "n", F.posexplode("prefix").alias("pos", "col"), F.col("cid").alias("comp"))
    cells = scratch.write(_several(cells), "cells")

    edges = None
    for k in range(ROUNDS):
        # each column's rows with one of them: by turns the one with the fewest rarer shingles, as the
        # middle of a group of near copies has, and any
        order = F.struct("pos", F.xxhash64("cid", "col")) if k % 2 == 0 else F.struct(F.xxhash64("cid", "col", F.lit(k)))
        hub = cells.groupBy("col").agg(F.min(F.struct(order.alias("order"), "cid", "n", "pos", "comp")).alias("h"))
        pairs = _products(hub.select("col", "h.cid", "h.n", "h.pos", "h.comp"), cells, t, ["col"])
        best = pairs.groupBy("v").agg(F.max(F.struct("shared", "u", "nu", "nv")).alias("p")).select("p.u", "p.nu", "v", "p.nv")
        new = scratch.write(_verified(sets, scratch.write(best, "pairs"), t), "links")
        found = new.count()
        if not found and edges is not None:
            break
        parts = scratch.write(connected_components(new if edges is None else edges.unionByName(new)), "parts")
        edges = parts.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
        placed = cells.drop("comp").join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("col", "cid", "n", "pos", F.coalesce("component_id", "cid").alias("comp"))
        cells = scratch.write(_several(placed), "cells")
        if found <= GOES_ON * cells.select("cid").distinct().count():
            break

    # the last product: whatever is still apart
    left, right = _blocked(cells.join(sets.select("cid", *SKETCH), "cid"))
    pairs = scratch.write(_products(left, right, t, ["col", "i", "j"]).select("u", "nu", "v", "nv"), "pairs")
    new = scratch.write(_verified(sets, pairs, t), "links")
    parts = connected_components(edges.unionByName(new))
    classes = scratch.write(classes.join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("component_id", "cid")).drop("component_id"), "classes")
    scratch.drop("wanted", "sets", "pairs", "links", "parts", "cells", "shared")
    return ids.drop("row"), classes


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, threshold: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size and component of every document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= threshold * union of their shingle
    sets. Null and empty texts, and texts without a word, have no set and link with
    nothing. A row comes back for each row of docs; an id given to several texts is
    compared by each of them, and links them all (their sizes are each row's own). Rows
    with a null id have a null component. Other columns, of any name, are not read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    ids, classes = _classes(_rows(docs, id_col, text_col), threshold, width, scratch)
    member = ids.join(classes, ["n", "h1", "h2"]).where("doc_id is not null")
    roots = classes.groupBy("root").agg(F.min("rep").alias("least"))
    # an id of several texts brings their components together
    tied = member.groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("most"), F.collect_set("root").alias("roots")).where("u < most")
    tied = scratch.write(tied.select("u", F.explode("roots").alias("v")), "tied")
    if tied.isEmpty():
        roots = roots.withColumn("top", F.col("root"))
    else:
        joined = connected_components(tied).withColumnsRenamed({"id": "root", "component_id": "top"})
        roots = roots.join(joined, "root", "left").withColumn("top", F.coalesce("top", "root"))
    tops = roots.groupBy("top").agg(F.min("least").alias("component_id"))
    placed = classes.join(roots.select("root", "top"), "root").join(tops, "top").select("n", "h1", "h2", "component_id")
    out = ids.join(placed, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, threshold: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each group of linked texts the one of the smallest id stays, once.

    Columns are as in docs. Of several texts of that id in one group the first by digest
    stays; texts of one id that are no near copies of each other all stay. Rows without
    an id, and rows whose text has no word, stay; of rows equal in id and text one does.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    ids, classes = _classes(_rows(docs, id_col, text_col), threshold, width, scratch)
    chosen = classes.groupBy("root").agg(F.min(F.struct("rep", "h1", "h2", "n")).alias("c")).select(F.col("c.rep").alias("doc_id"), "c.h1", "c.h2", "c.n", F.lit(True).alias("kept"))
    known = ids.where("doc_id is not null").join(chosen, ["doc_id", "n", "h1", "h2"], "left").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and(F.coalesce("kept", F.col("n") == 0)).alias("stays"))
    out_ids = scratch.write(known.where("rows > 1 or not stays").select("doc_id", (F.col("rows") > 1).alias("again")), "out")
    id_of = F.col(id_col).cast("long")
    clear = docs.join(small(out_ids.select(F.col("doc_id").alias("_out"))), id_of == F.col("_out"), "left_anti")
    # ids of several rows: by the digest of each row's own text
    again = docs.join(small(scratch.write(out_ids.where("again").select(F.col("doc_id").alias("_again")), "again")), id_of == F.col("_again"), "left_semi")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.frombuffer(b"".join([digests(shingle_hashes(t, width)) for t in texts_of(batch, text_col)]), np.int64).reshape(-1, 3)
        return pa.record_batch([*batch.columns, *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(3))], [*batch.schema.names, "_h1", "_h2", "_n"])

    marked = map_arrow(again, digest, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in ("_h1", "_h2", "_n"))]))
    c = chosen.select(*(F.col(x).alias(f"_c_{x}") for x in ("doc_id", "n", "h1", "h2")))
    same = (id_of == F.col("_c_doc_id")) & (F.col("_n") == F.col("_c_n")) & (F.col("_h1") == F.col("_c_h1")) & (F.col("_h2") == F.col("_c_h2"))
    kept = marked.where("_n > 0").join(c, same, "left_semi").dropDuplicates([id_col, "_h1", "_h2", "_n"])
    bare = marked.where("_n = 0").dropDuplicates([id_col, text_col])
    return clear.select(docs.columns).unionByName(kept.select(docs.columns)).unionByName(bare.select(docs.columns))
