"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the separator of the word contracts.
SPACES = "\\x20\\x09-\\x0D"
#: An Arrow batch ends at so many bytes, however few rows that is.
BATCH_BYTES = 8 << 20
#: A side of a join with so few rows of a few numbers may be broadcast (about 100 MB in a worker); larger ones are shuffled.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a local session names none, as in tests, a local default stands in; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file:///tmp/checkpoints/chronoweave").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage: the rows survive lost executors and are computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run in the shared folder, dropped by name once what needs them is written."""

    def __init__(self, spark: SparkSession, label: str):
        self._spark, self._base, self._paths = spark, fresh_path(spark, label), {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back; a table of that name from before is dropped after."""
        before = self._paths.get(name)
        path = self._paths[name] = f"{self._base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if before:
            self._delete(before)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Tables that no later plan reads; shuffles behind them go when the cleaner finds them unreferenced."""
        for name in names:
            self._delete(self._paths.pop(name))
        self._spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of a few numbers a row, marked for broadcast if its row count allows it; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], held: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of their group, left joined; keys are never null.

    groups is a written table with a row for each group and its number of rows in
    `held`. Few groups are broadcast. Of many, those that hold so many rows that only few
    such groups can exist are broadcast, and the rows of the others are shuffled: no
    task gets a large group whole.
    """
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), keys, "left")
    heavy = groups.agg(F.sum(held)).first()[0] / most
    large = F.broadcast(groups.where(F.col(held) > heavy))
    return rows.join(large, keys, "inner").unionByName(rows.join(large.select(*keys), keys, "left_anti").join(groups.where(F.col(held) <= heavy), keys, "left"))


def _give_back() -> None:
    """Hands the worker's freed memory back to the system, as the worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps it


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of bounded bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """map_batches with a function from batch to batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return map_batches(df, run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def recoded(texts: pa.Array, to: bytes) -> pa.Array:
    """texts with each byte replaced by that of a table of 256; the table leaves bytes over 127 alone."""
    _, offsets, data = texts.buffers()
    changed = pa.py_buffer(memoryview(data).tobytes().translate(to)) if data else data
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, changed], null_count=0, offset=texts.offset)


def partial_batch(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    """A batch with some of the columns; the others are null."""
    rows = len(next(iter(columns.values())))
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
