"""Ranked lexical search over a bit-sliced impact index.

Documents stand in blocks. For each term of a block the index has the places of its
documents and the bits of their impacts (what the term adds to a document's score), one
bitmap for each bit. A query adds the bitmaps of its terms by bitwise carries, for all
documents of a block at once, and finds the best by descending from the most significant
bitmap of the sums. Blocks are searched apart; their best are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch, column_of, map_arrow, map_batches, recoded, small

#: Documents of a block, and postings of it, at most (a block ends with the batch that reaches either).
BLOCK, POSTINGS = 32_768, 4_000_000
#: Bytes of query texts that are searched for at once; more are searched for in several passes over the index.
QUERY_BYTES = 16 << 20
#: Bytes of bitmaps that a task keeps spread out.
KEPT_BYTES = 32 << 20

#: A-Z in lower case; all that ends a term as a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))

_INDEX = "block long, term string, held long, n_docs long, n_terms long, places binary, doc_ids array<long>"
_POSTINGS = f"{_INDEX}, counts binary, lengths binary"
_SLICES = f"{_INDEX}, slices array<binary>"
_FOUND = "item_id long, doc_id long, score long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts, in order, and the text of each."""
    lists = pc.split_pattern(recoded(pc.fill_null(texts, ""), _TERMS), " ")
    there = pc.greater(pc.binary_length(lists.flatten()), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return lists.flatten().filter(there), text[there.to_numpy(zero_copy_only=False)]


def _asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term: the terms of each item, once each."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, text = terms_of(column_of(batch, "text"))
        return pa.record_batch([column_of(batch, "item_id").take(pa.array(text)), terms], ["item_id", "term"])

    return map_arrow(rows, one, "item_id long, term string").distinct()


class _Block:
    """Postings of the documents that a task reads, up to a block's size."""

    def __init__(self, vocabulary: pa.Array):
        self.vocabulary, self.ids, self.lengths, self.parts = vocabulary, [], [], []
        self.rows = self.postings = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        terms, text = terms_of(texts)
        lengths = np.bincount(text, minlength=len(texts))
        known = pc.index_in(terms, value_set=self.vocabulary)
        asked = known.is_valid().to_numpy(zero_copy_only=False)
        term, text = known.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), text[asked]
        pairs, counts = np.unique(term * len(texts) + text, return_counts=True)
        text = pairs % max(len(texts), 1)
        self.parts.append(np.stack([pairs // max(len(texts), 1), text + self.rows, counts, lengths[text]]))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.rows += len(texts)
        self.postings += len(pairs)

    def end(self, block: int) -> pa.RecordBatch:
        """A row for each term, and one without a term for the documents."""
        term, place, count, length = np.concatenate(self.parts, axis=1)
        order = np.argsort(term, kind="stable")
        term, place, count, length = term[order], place[order].astype("<u4"), count[order], length[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        cuts = [*starts.tolist(), len(term)]
        each = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] + [None]
        lengths = np.concatenate(self.lengths)
        k = len(starts)
        last = lambda x: pa.array([None] * k + [x], pa.int64())
        docs = pa.array([None] * k + [pa.concat_arrays(self.ids).to_pylist()], pa.list_(pa.int64()))
        columns = {
            "block": pa.array([block] * (k + 1), pa.int64()),
            "term": pa.array([*self.vocabulary.take(pa.array(term[starts])).to_pylist(), None], pa.string()),
            "held": pa.array([*np.diff(cuts).tolist(), self.rows], pa.int64()),
            "n_docs": last(int((lengths > 0).sum())),
            "n_terms": last(int(lengths.sum())),
            "places": pa.array(each(place), pa.binary()),
            "doc_ids": docs,
            "counts": pa.array(each(count.astype("<u4")), pa.binary()),
            "lengths": pa.array(each(length.astype("<u4")), pa.binary()),
        }
        return pa.record_batch(list(columns.values()), list(columns))


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the given terms in blocks of documents, from one pass over the whole texts.

    A row for each term of a block: held (its documents), and as binaries (32 bits a number)
    their places in the block, counts of the term and lengths in terms. A row
    without a term for each block: held (documents), n_docs (those with a term), n_terms
    (all their terms) and doc_ids by place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.string())
        first = TaskContext.get().partitionId() << 32
        number, block = 0, _Block(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            block.add(column_of(batch, "doc_id"), column_of(batch, "text"))
            if block.rows >= BLOCK or block.postings >= POSTINGS:
                yield block.end(first + number)
                number, block = number + 1, _Block(vocabulary)
        if block.rows:
            yield block.end(first + number)

    return map_batches(rows, blocks, _POSTINGS)


def impacts(weight: int, counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term of this weight adds to the scores of documents that hold it `counts` times in `lengths` terms.

    n documents have a term, with repeats `total` terms.
    """
    norm = 50 + (50 * lengths * n) // total
    return weight * ((1_000_000_000 * counts) // (1000 * counts + 20 * norm))


def impact_index(rows: DataFrame, scratch: Scratch, label: str = "weights") -> DataFrame:
    """The bit-sliced index of written postings: for each term of a block a bitmap for each bit of its documents' impacts.

    Bitmaps are over the term's own documents, in order of their places; the least
    significant comes first. Terms of weight 0 are left out.
    """
    n, total = rows.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weight = F.floor(F.log((F.lit(2.0) * n + 2) / (F.col("df") * 2 + 1)) * 1000).cast("long")
    weights = scratch.write(rows.where("term is not null").groupBy("term").agg(F.sum("held").alias("df")).select("term", weight.alias("weight")), label)
    weighed = rows.join(small(weights), "term", "left").where("term is null or weight > 0").select(*rows.columns, "weight")
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        slices = []
        for w, c, s in zip(*(column_of(batch, x).to_pylist() for x in ("weight", "counts", "lengths")), strict=True):
            if c is None:
                slices.append(None)
                continue
            x = impacts(w, np.frombuffer(c, "<u4").astype(np.int64), np.frombuffer(s, "<u4").astype(np.int64), n, total)
            slices.append([np.packbits((x >> b & 1).astype(np.uint8)).tobytes() for b in range(int(x.max()).bit_length())])
        return pa.record_batch([*(column_of(batch, c) for c in names), pa.array(slices, pa.list_(pa.binary()))], [*names, "slices"])

    return map_arrow(weighed, one, _SLICES)


class Slices:
    """Bitmaps over all documents of a block, from those over a term's own documents."""

    def __init__(self, docs: int):
        self.words = -(-docs // 64)
        self._kept: dict[str, np.ndarray] = {}
        self._bytes = 0

    def spread(self, term: str, places: bytes, slices: list[bytes]) -> np.ndarray:
        """bitmaps (bits, words); a bounded number of them is kept for the next query."""
        if (found := self._kept.get(term)) is None:
            at = np.frombuffer(places, "<u4")
            bits = np.unpackbits(np.stack([np.frombuffer(s, np.uint8) for s in slices]), axis=1, count=len(at)) if slices else np.empty((0, len(at)), np.uint8)
            wide = np.zeros((len(slices), self.words * 64), np.uint8)
            wide[:, at] = bits
            found = np.packbits(wide, axis=1, bitorder="little").view("<u8")
            if self._bytes + found.nbytes <= KEPT_BYTES:
                self._kept[term] = found
                self._bytes += found.nbytes
        return found


def added(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Sums of bit-sliced numbers, bit-sliced; none is over `most`.

    Full adders keep sum bits and carry bits apart for all slices at once; one ripple of
    the carries ends it.
    """
    bits = max(most.bit_length(), 1)
    total, carry = np.zeros((2, bits, parts[0].shape[1]), np.uint64)
    for x in parts:
        k = len(x)
        low, high = total[:k] ^ x, total[:k] & x
        total[:k] = low ^ carry[:k]
        high |= low & carry[:k]
        # beyond x only the two are added: a half adder
        rest = total[k:] & carry[k:]
        total[k:] ^= carry[k:]
        moved = np.concatenate([high, rest])
        carry[1:], carry[0] = moved[:-1], 0
    over = np.zeros_like(total[0])
    for b in range(bits):
        low = total[b] ^ carry[b]
        up = (total[b] & carry[b]) | (low & over)
        total[b] = low ^ over
        over = up
    return total


def best_of(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents whose sums are above the k-th largest, and of those equal to it; sums of 0 are in neither."""
    sure = np.zeros_like(sums[0])
    open_ = np.bitwise_or.reduce(sums, axis=0)
    if int(np.bitwise_count(open_).sum()) <= k:
        return open_, sure
    for bit in sums[::-1]:
        ones = open_ & bit
        n = int(np.bitwise_count(sure | ones).sum())
        if n > k:
            open_ = ones
        else:
            sure |= ones
            open_ &= ~bit
            if n == k:
                return sure, np.zeros_like(sure)
    return sure, open_


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _searched(index: pa.Table, items: list[tuple[int | None, list[str]]], k: int) -> pa.Table:
    """The best k documents of one block for each item."""
    rows = {t: (p, s) for t, p, s in zip(*(index.column(c).to_pylist() for c in ("term", "places", "slices")), strict=True)}
    ids = next(x for x in index.column("doc_ids") if x.is_valid).values
    order = np.empty(len(ids), np.int64)  # of the documents by id, those without one last
    order[pc.sort_indices(ids, null_placement="at_end").to_numpy(zero_copy_only=False)] = np.arange(len(ids))
    block = Slices(len(ids))
    found, at, score = [], [], []
    for item, terms in items:
        parts = [block.spread(t, *rows[t]) for t in terms if t in rows]
        if not parts:
            continue
        sums = added(parts, sum((1 << len(p)) - 1 for p in parts))
        sure, even = best_of(sums, k)
        own, ties = _places(sure), _places(even)
        own = np.concatenate([own, ties[np.argsort(order[ties], kind="stable")[: k - len(own)]]])
        bit = (sums[:, own >> 6] >> (own & 63).astype(np.uint64)) & np.uint64(1)
        score.append((bit.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0))
        at.append(own)
        found += [item] * len(own)
    at, score = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, score))
    return pa.table({"item_id": pa.array(found, pa.int64()), "doc_id": ids.take(pa.array(at, pa.int64())), "score": pa.array(score, pa.int64())})


def _one_pass(spark: SparkSession, docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, scratch: Scratch, number: int) -> DataFrame:
    items: dict[int | None, list[str]] = {}
    for r in asked.orderBy("item_id", "term").toLocalIterator():
        items.setdefault(r.item_id, []).append(r.term)
    terms = sorted({t for own in items.values() for t in own})
    rows = scratch.write(postings(docs, terms, id_col, text_col), f"postings-{number}")
    sent = spark.sparkContext.broadcast(list(items.items()))
    return impact_index(rows, scratch, f"weights-{number}").groupBy("block").applyInArrow(lambda index: _searched(index, sent.value, k), _FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents of the highest scores for each item: item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal scores rank by id, a null id last. Each row of docs
    is a document, so a repeated id may come several times. Rows of one item_id, or
    without one, are one item with the terms of all. A null or empty text has no terms:
    such items find nothing, such documents are never found. Empty tables give an empty table. Other columns, of any name, are not read.

    The index is built for the terms that are asked for. Queries of up to QUERY_BYTES of
    text are searched for at once; more are dealt by their id's hash over several passes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = scratch.write(_asked(items, item_col, item_text), "asked")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    passes = -(-size // QUERY_BYTES)
    part = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(max(passes, 1)))
    found = spark.createDataFrame([], _FOUND)
    for p in range(passes):
        found = found.unionByName(_one_pass(spark, docs, asked.where(part == p), k, id_col, text_col, scratch, p))
    # each task's best go on alone, so an item's rows are few
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
