"""Members of payload files, read on the executors by their place in the file.

Readers are dealt out by file and range: rows of one stretch of a file come to one task
in order of their offsets, which opens the file once and reads its members' bytes alone.
Archives are looked at by their directory; of the values only the header is read.
Folders may be local or in any store that pyarrow's file systems know by their address.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file whose members go to one task.
SPAN = 64 << 20
#: Bytes that are read at a time where a line's length is not known.
LINE = 64 << 10


class Files:
    """Files below a root; the last one stays open for the next row."""

    def __init__(self, root: str):
        self.files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        self.base, self._at, self._open = base.rstrip("/"), None, None

    def path(self, ref: str) -> str:
        return f"{self.base}/{ref.lstrip('/')}"

    def exists(self, ref: str) -> bool:
        return self.files.get_file_info(self.path(ref)).type == fs.FileType.File

    def opened(self, ref: str):
        if ref != self._at:
            self.close()
            self._open, self._at = self.files.open_input_file(self.path(ref)), ref
        return self._open

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
        self._open = self._at = None

    def read(self, ref: str, offset: int, nbytes: int | None) -> bytes:
        """The bytes at an offset; without a length, up to the end of the line."""
        f = self.opened(ref)
        if offset < 0:
            raise ValueError("negative offset")
        if nbytes and nbytes > 0:
            return f.read_at(nbytes, offset)
        line = b""
        while b"\n" not in line and (more := f.read_at(LINE, offset + len(line))):
            line += more
        return line.split(b"\n", 1)[0]


def read_members(rows: DataFrame, root: str, ref: str = "artifact_ref", offset: str = "byte_offset", nbytes: str = "nbytes") -> DataFrame:
    """rows with `data` (the member's bytes) and `problem` (why there are none).

    A row without a file name or an offset has a problem, as one whose file is not
    there. A length that is null or not positive reads to the end of the line.
    """
    taken = {"data", "problem"} & set(rows.columns)
    if taken:
        raise ValueError(f"rows have columns of the result: {sorted(taken)}")
    dealt = rows.withColumn("_span", F.floor(F.col(offset) / SPAN)).repartition(F.col(ref), F.col("_span")).sortWithinPartitions(ref, offset).drop("_span")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for batch in batches:
            data, problems = [], []
            for r, at, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (ref, offset, nbytes)), strict=True):
                found = problem = None
                try:
                    if not r or at is None:
                        raise ValueError("no file name or no offset")
                    found = files.read(r, at, n)
                except (OSError, ValueError) as e:
                    problem = str(e) or type(e).__name__
                data.append(found)
                problems.append(problem)
            yield pa.record_batch([*batch.columns, pa.array(data, pa.binary()), pa.array(problems, pa.string())], [*batch.schema.names, "data", "problem"])
        files.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(read, f"{kinds}, data binary, problem string")


def read_json_members(rows: DataFrame, root: str, payload_type: str, **columns: str) -> DataFrame:
    """rows with `payload` of the JSON line at each row's offset, and `problem`; a line that is no JSON object with a payload is a problem too."""
    found = read_members(rows, root, **columns)
    line = F.from_json(F.decode("data", "UTF-8"), f"payload {payload_type}, sample_index long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    found = found.withColumn("_line", F.when(F.col("data").isNotNull(), line))
    bad = F.col("_line._bad").isNotNull() | (F.col("data").isNotNull() & F.col("_line").isNull())
    return found.select(*rows.columns, F.when(~F.coalesce(bad, F.lit(False)), F.col("_line.payload")).alias("payload"), F.coalesce("problem", F.when(bad, "no JSON line at this offset")).alias("problem"))


def _header(archive: zipfile.ZipFile, name: str) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an archive's array, without its values."""
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        return shape, dtype


def _array(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    with archive.open(f"{name}.npy") as f:
        return np.lib.format.read_array(f, allow_pickle=False)


def bundle_problems(f) -> list[str]:
    """What is wrong with a ragged bundle: an open archive of sample_index, offsets and values."""
    with zipfile.ZipFile(f) as archive:
        index, offsets = _array(archive, "sample_index"), _array(archive, "offsets")
        shape, _ = _header(archive, "values")
    checks = {
        "offsets are not one more than the samples": len(offsets) != len(index) + 1,
        "first offset is not 0": len(offsets) > 0 and offsets[0] != 0,
        "offsets fall": bool((np.diff(offsets) < 0).any()),
        "last offset is not the number of values": len(offsets) > 0 and offsets[-1] != (shape[0] if shape else 0),
        "sample index repeats": len(np.unique(index)) != len(index),
    }
    return [issue for issue, bad in checks.items() if bad]


def file_states(refs: DataFrame, root: str) -> DataFrame:
    """ref, there, problems: whether each file (ref, format) exists below root, and what is wrong with a ragged bundle.

    Every distinct file is looked at once, by one task.
    """
    dealt = refs.select("ref", "format").distinct().repartition(F.col("ref"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for batch in batches:
            there, problems = [], []
            for ref, kind in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ref", "format")), strict=True):
                there.append(bool(ref) and files.exists(ref))
                found = []
                if there[-1] and kind == "ragged_npz":
                    try:
                        found = [f"invalid ragged bundle: {x}" for x in bundle_problems(files.opened(ref))]
                    except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile, zlib.error) as e:
                        found = [f"ragged bundle cannot be read: {e}"]
                problems.append(found)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("ref")), pa.array(there, pa.bool_()), pa.array(problems, pa.list_(pa.string()))], ["ref", "there", "problems"])
        files.close()

    states = dealt.mapInArrow(look, "ref string, there boolean, problems array<string>")
    return states.groupBy("ref").agg(F.max("there").alias("there"), F.array_distinct(F.flatten(F.collect_list("problems"))).alias("problems"))  # a row for each format of a file


def member_place(key: str) -> tuple:
    """Columns byte_offset and nbytes of a member's key, a JSON text."""
    parsed = F.from_json(F.coalesce(key, F.lit("{}")), "byte_offset long, nbytes long")
    return parsed["byte_offset"].alias("byte_offset"), parsed["nbytes"].alias("nbytes")
