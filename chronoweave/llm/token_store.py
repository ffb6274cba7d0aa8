"""Token ids of documents in binary shards with a perfect hash index.

A store is a folder of shards in ascending id order. Each shard is two files: `.ids`,
the raw ids as little-endian integers of one width, and `.rows`, a record of fixed
width for each document. Over all shards lies one index: keys are dealt to buckets by
their hash, and each bucket is a file with a minimal perfect hash, a fingerprint and
the document's place for each key. A lookup reads a few bytes of its bucket, one row
and the ids themselves, whatever the store's size. The manifest, a Parquet table beside
them, names the shards that count: what a lost or repeated task has left behind is not
in it. Files go through pyarrow's file systems, so the folder may be on any store that
driver and executors share.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.bpe import default_tokenizer, encoder
from chronoweave.llm.common import column_of, map_batches, texts_of
from chronoweave.llm.perfect_hash import HashFile, PerfectHash, mix

#: A shard is closed when it holds so many bytes of ids: what a task has in memory stays bounded.
SHARD_BYTES = 16 << 20
#: Documents that are encoded together.
ENCODE_ROWS = 256
#: Keys of a bucket of the index, about.
BUCKET_KEYS = 1 << 18

_SHARD = "part long, seq long, name string, n_docs long, n_tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Fixed-width records: a shard's documents, the index's places, the shards' names by number.
_ROW = np.dtype([("key", "<i8"), ("end", "<i8"), ("known", "<i8")])
_PLACE = np.dtype([("rows", "<i8"), ("shard", "<i8"), ("row", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])
_NAME = 64


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _save(path: str, name: str, data: bytes) -> None:
    fs, at = _folder(path)
    with fs.open_output_stream(f"{at}/{name}") as f:
        f.write(data)


class _Shard:
    """Rows of one shard, in order, until it is written."""

    def __init__(self):
        self.ids: list[bytes] = []
        self.keys: list[int | None] = []
        self.size = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.ids.append(ids)
        self.keys.append(key)
        self.size += len(ids)

    def write(self, path: str, part: int, seq: int, attempt: int, width: int) -> tuple:
        name = f"shard-{part:06d}-{seq:05d}-{attempt}"
        rows = np.zeros(len(self.keys), _ROW)
        rows["key"], rows["known"] = [k or 0 for k in self.keys], [k is not None for k in self.keys]
        rows["end"] = np.cumsum([len(x) // width for x in self.ids])
        _save(path, f"{name}.ids", b"".join(self.ids))
        _save(path, f"{name}.rows", rows.tobytes())
        return part, seq, name, len(rows), int(rows["end"][-1])


def _rows_of(path: str, name: str) -> np.ndarray:
    fs, at = _folder(path)
    with fs.open_input_stream(f"{at}/{name}.rows") as f:
        return np.frombuffer(f.read(), _ROW)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with each shard's number and the ids of all before it; a row for each 16 MB of ids."""
    order = W.orderBy("part", "seq")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return spark.read.schema(_SHARD).parquet(f"{path}/manifest").select("name", before.alias("before"), (F.row_number().over(order) - 1).cast("long").alias("shard"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64), 40_503) % np.uint64(buckets)).astype(np.int64)


def _write_index(spark: SparkSession, path: str, width: int) -> None:
    """Bucket files over all shards: a key's first row, how many follow it, and where its ids are."""
    shards = _numbered(spark, path)
    names = "".join(r["name"].ljust(_NAME) for r in shards.orderBy("shard").select("name").toLocalIterator())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shard in zip(column_of(batch, "name").to_pylist(), column_of(batch, "shard").to_pylist(), strict=True):
                rows = _rows_of(path, name)
                starts = np.concatenate([[0], rows["end"][:-1]])
                known = np.flatnonzero(rows["known"])
                # rows of one key stand together: its first in this shard, and their number
                key, first, count = np.unique(rows["key"][known], return_index=True, return_counts=True)
                at = known[first]
                yield pa.record_batch([pa.array(key), pa.array(np.full(len(at), shard)), pa.array(at), pa.array(starts[at]), pa.array(rows["end"][at] - starts[at]), pa.array(count)], ["key", "shard", "row", "offset", "n_tokens", "rows"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = map_batches(shards.repartition(tasks, "shard"), places, "key long, shard long, row long, offset long, n_tokens long, rows long")
    keys = found.groupBy("key").agg(F.min(F.struct("shard", "row", "offset", "n_tokens")).alias("first"), F.sum("rows").alias("rows"))
    n = spark.read.schema(_SHARD).parquet(f"{path}/manifest").agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_KEYS))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(bucket_of(column_of(batch, "key").to_numpy(), buckets))], [*batch.schema.names, "bucket"])

    def build(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        keys = table.column("key").to_numpy()
        index = PerfectHash.build(keys)
        slots = index.slots(keys)
        if sorted(slots.tolist()) != list(range(len(keys))):
            raise ValueError(f"bucket {number}: the hash is not perfect")
        records = np.zeros(len(keys), _PLACE)
        for field in _PLACE.names:
            records[field][slots] = table.column(field).to_numpy()
        _save(path, f"bucket-{number:08d}", index.to_bytes(records))
        return pa.table({"bucket": pa.array([number]), "keys": pa.array([len(keys)])})

    flat = keys.select("key", "first.*", "rows")
    placed = map_batches(flat, bucket, "key long, shard long, row long, offset long, n_tokens long, rows long, bucket long")
    placed.groupBy("bucket").applyInArrow(build, "bucket long, keys long").write.mode("overwrite").parquet(f"{path}/buckets")
    _save(path, "shards", names.encode())
    _save(path, "store.json", json.dumps({"buckets": buckets, "width": width}).encode())


def write_token_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write the store; returns its manifest.

    docs: one row per document; other columns, of any name, are not read. Strings of the
    tokenizer's special tokens in a text become those tokens. Null and empty texts hold
    the end id alone. Null ids come first and are not in the index; rows of one id stand
    together, in an order by their text's hash, and the index gives all of them. An empty
    table gives an empty manifest.

    One range shuffle by id and, inside an id, by hash: an id of very many rows, or very
    many rows without one, spread over tasks. A shard holds at most SHARD_BYTES and one document.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    fs, at = _folder(path)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        task = TaskContext.get()
        part, attempt, seq, shard, done = task.partitionId(), task.taskAttemptId(), 0, _Shard(), []
        for batch in batches:
            keys, texts = column_of(batch, "doc_id").to_pylist(), texts_of(batch)
            for k in range(0, len(texts), ENCODE_ROWS):
                for key, ids in zip(keys[k : k + ENCODE_ROWS], enc.encode(texts[k : k + ENCODE_ROWS]), strict=True):
                    shard.add(key, ids + end)
                    if shard.size >= SHARD_BYTES:
                        done.append(shard.write(path, part, seq, attempt, enc.dtype.itemsize))
                        seq, shard = seq + 1, _Shard()
        if shard.keys:
            done.append(shard.write(path, part, seq, attempt, enc.dtype.itemsize))
        if done:
            names = [f.split()[0] for f in _SHARD.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)), schema=pa.schema([(n, pa.string() if n == "name" else pa.int64()) for n in names]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("salt", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = rows.repartitionByRange(parts, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    map_batches(shards, write, _SHARD).write.mode("overwrite").parquet(f"{path}/manifest")
    _write_index(spark, path, encoder(tokenizer).dtype.itemsize)
    return spark.read.schema(_SHARD).parquet(f"{path}/manifest")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the crc32 of the
    ids as little-endian unsigned 32-bit integers. Each shard is read by one task.
    """
    reader = StoreReader(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _folder(path)
        for batch in batches:
            for name, before in zip(column_of(batch, "name").to_pylist(), column_of(batch, "before").to_pylist(), strict=True):
                rows = _rows_of(path, name)
                with fs.open_input_stream(f"{at}/{name}.ids") as f:
                    ids = np.frombuffer(f.read(), f"<u{width}").astype("<u4")
                starts = np.concatenate([[0], rows["end"][:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), rows["end"].tolist(), strict=True)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(rows["key"]), mask=rows["known"] == 0), pa.array(starts + before), pa.array(rows["end"] - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    width = reader.width
    placed = _numbered(spark, path).select("name", "before")
    return map_batches(placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), read, _ROWS)


class StoreReader:
    """Keyed access to a store: bytes read do not depend on its size."""

    def __init__(self, path: str):
        self._fs, self._at = _folder(path)
        with self._fs.open_input_stream(f"{self._at}/store.json") as f:
            about = json.loads(f.read())
        self.width, self._buckets = about["width"], about["buckets"]

    def _bytes(self, name: str, at: int, n: int) -> bytes:
        with self._fs.open_input_file(f"{self._at}/{name}") as f:
            f.seek(at)
            return f.read(n)

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each row of a key, in the store's order; empty for a key that is not there."""
        name = f"bucket-{int(bucket_of(np.array([key], np.int64), self._buckets)[0]):08d}"
        if self._fs.get_file_info(f"{self._at}/{name}").type == pafs.FileType.NotFound:
            return []
        with self._fs.open_input_file(f"{self._at}/{name}") as f:
            place = HashFile(f, _PLACE).find(key)
        if place is None:
            return []
        shard, row, at, n = (int(place[x]) for x in ("shard", "row", "offset", "n_tokens"))
        out: list[np.ndarray] = []
        while len(out) < place["rows"]:
            name = self._bytes("shards", _NAME * shard, _NAME).decode().strip()
            record = np.frombuffer(self._bytes(f"{name}.rows", _ROW.itemsize * row, _ROW.itemsize), _ROW)
            if not len(record):  # the key goes on in the next shard
                shard, row, at = shard + 1, 0, 0
                continue
            # a fingerprint lets one foreign key in 2**32 pass: the row's own key decides
            if record["key"][0] != key:
                return []
            n = int(record["end"][0]) - at
            out.append(np.frombuffer(self._bytes(f"{name}.ids", at * self.width, n * self.width), f"<u{self.width}"))
            row, at = row + 1, at + n
        return out


def get_documents(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of single documents by key; absent keys are left out, a key of several rows gives each of them. No Spark job."""
    reader = StoreReader(path)
    return {key: found for key in dict.fromkeys(keys) if (found := reader.get(key))}


def find_documents(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids: a row for each stored row of each key in keys, looked up through the index; absent and null keys give none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = StoreReader(path)
        for batch in batches:
            found = [(k, ids.astype(np.int64)) for k in column_of(batch, "doc_id").to_pylist() if k is not None for ids in reader.get(k)]
            if found:
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int64()), pa.array([ids for _, ids in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_batches(keys.select(F.col(id_col).cast("long").alias("doc_id")), find, "doc_id long, ids array<long>")
