"""Packed recordings (`<environment>/S*/point_clouds.npy` and `kpts.npy`) as rows of frames.

A Python data source: the plan is made from the files' headers, which give the place of
every frame; a partition is a range of frames, and a task reads just the bytes of its
range from both files. Folders may be local or in any store that pyarrow's file systems
know by their address (file, hdfs, s3, gs).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronoweave.functions import geometry as g
from chronoweave.operators.frames import evenly, strided_windows

FRAMES = "environment string, subject string, frame long, points array<array<float>>, pose array<array<float>>"
#: The files of a recording, joints of a pose and numbers of a joint, and the least columns of a point.
CLOUDS, POSES, POSE_SHAPE, POINT_COLUMNS = "point_clouds.npy", "kpts.npy", (17, 3), 5
#: Bytes of a partition, about, and of a batch.
PART_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Bytes from a file's start that hold its header; longer headers are read on.
HEADER = 4096


@dataclass(frozen=True)
class Packed:
    """An .npy file of frames: where the first begins, and what a frame is."""

    path: str
    start: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def frame_bytes(self) -> int:
        return int(np.prod(self.shape[1:])) * np.dtype(self.dtype).itemsize

    def read(self, files: fs.FileSystem, first: int, last: int) -> np.ndarray:
        """Frames first to last - 1, and no other bytes."""
        with files.open_input_file(self.path) as f:
            data = f.read_at((last - first) * self.frame_bytes, self.start + first * self.frame_bytes)
        return np.frombuffer(data, self.dtype).reshape(last - first, *self.shape[1:])


def npy_header(files: fs.FileSystem, path: str) -> Packed:
    """What the header of an .npy file says."""
    with files.open_input_file(path) as f:
        size = HEADER
        while True:
            head = io.BytesIO(f.read_at(min(size, f.size()), 0))
            try:
                version = np.lib.format.read_magic(head)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, fortran, dtype = read(head, max_header_size=1 << 20)
                break
            except ValueError:
                if size >= f.size() or size > 1 << 20:
                    raise
                size *= 16
    if fortran or dtype.hasobject:
        raise ValueError(f"{path}: frames must lie one after the other as plain numbers")
    return Packed(path, head.tell(), shape, dtype.str)


def recordings(root: str) -> list[tuple[str, str, Packed, Packed]]:
    """environment, subject, clouds and poses of every recording under root, in order; read from the headers alone."""
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    there = {f.path for f in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File}
    out = []
    for path in sorted(there):
        parts = path[len(base) + 1 :].split("/")
        if len(parts) != 3 or not parts[1].startswith("S") or parts[2] != CLOUDS or path[: -len(CLOUDS)] + POSES not in there:
            continue
        clouds, poses = npy_header(files, path), npy_header(files, path[: -len(CLOUDS)] + POSES)
        if len(clouds.shape) != 3 or clouds.shape[2] < POINT_COLUMNS or poses.shape[1:] != POSE_SHAPE or clouds.shape[0] != poses.shape[0]:
            raise ValueError(f"{path}: unexpected shapes {clouds.shape} and {poses.shape}")
        out.append((parts[0], parts[1], clouds, poses))
    return out


@dataclass
class FrameRange(InputPartition):
    environment: str
    subject: str
    clouds: Packed
    poses: Packed
    first: int
    last: int


class PackedReader(DataSourceReader):
    def __init__(self, root: str, part_bytes: int, chosen: dict[str, set[str]]):
        self.root, self.part_bytes, self.chosen = root, part_bytes, chosen

    def partitions(self) -> list[FrameRange]:
        out = []
        for environment, subject, clouds, poses in recordings(self.root):
            own = {"environment": environment, "subject": subject}
            if not all(own[c] in values for c, values in self.chosen.items()):
                continue
            step = max(1, self.part_bytes // max(1, clouds.frame_bytes + poses.frame_bytes))
            out += [FrameRange(environment, subject, clouds, poses, a, min(a + step, clouds.shape[0])) for a in range(0, clouds.shape[0], step)]
        return out

    def read(self, part: FrameRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no recording
            return
        files = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        step = max(1, BATCH_BYTES // max(1, part.clouds.frame_bytes + part.poses.frame_bytes))
        for a in range(part.first, part.last, step):
            b = min(a + step, part.last)
            columns = [pa.array([x] * (b - a)) for x in (part.environment, part.subject)]
            yield pa.record_batch([*columns, pa.array(np.arange(a, b)), *(_nested(x.read(files, a, b)) for x in (part.clouds, part.poses))], ["environment", "subject", "frame", "points", "pose"])


def _nested(x: np.ndarray) -> pa.Array:
    """frames x rows x numbers as lists of lists."""
    n, rows, width = x.shape
    offsets = lambda k, each: pa.array(np.arange(k + 1, dtype=np.int32) * each)
    inner = pa.ListArray.from_arrays(offsets(n * rows, width), pa.array(x.astype(np.float32).reshape(-1)))
    return pa.ListArray.from_arrays(offsets(n, rows), inner)


class PackedFrames(DataSource):
    """`spark.read.format("packed_frames").load(root)`: a row for each frame.

    Options: partBytes, bytes of a partition; environment and subject, comma-joined names
    of the recordings to read.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> PackedReader:
        chosen = {c: set(self.options[c].split(",")) for c in ("environment", "subject") if self.options.get(c)}
        return PackedReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)), chosen)


def packed_frames(spark: SparkSession, root: str, part_bytes: int = PART_BYTES, **chosen: str) -> DataFrame:
    """environment, subject, frame, points, pose of all recordings under root, or of those of the given environment and subject names."""
    spark.dataSource.register(PackedFrames)
    return spark.read.format("packed_frames").option("partBytes", part_bytes).options(**chosen).load(root)


def packed_records(spark: SparkSession, root: str) -> DataFrame:
    """environment, subject, n_frames, clouds, poses (paths) of the recordings under root; only headers are read."""
    rows = [(e, s, c.shape[0], c.path, p.path) for e, s, c, p in recordings(root)]
    return spark.createDataFrame(rows, "environment string, subject string, n_frames long, clouds string, poses string")


def packed_samples(spark: SparkSession, root: str, maximum: int, width: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """environment, subject, frame, points, frames (a window of point arrays), pose: an even selection of whole windows.

    Of all centres that a window of width frames fits around, `maximum` are taken evenly
    over the recordings in order (all, if maximum is 0 or less). Windows with an empty
    frame and centres with a pose that is not finite are left out. Points and poses are
    in the model's channel and axis order, points without padding.
    """
    if width < 1 or width % 2 == 0:
        raise ValueError("window width must be odd and positive")
    half, run = width // 2, ["environment", "subject"]
    records, start, rows = recordings(root), 0, []
    for environment, subject, clouds, _ in records:
        centres = max(0, clouds.shape[0] - 2 * half)
        rows.append((environment, subject, start, centres))
        start += centres
    if not start:
        raise ValueError(f"{root}: no recording is long enough for a window of {width} frames")
    # the headers tell every centre's place among all, so nothing needs to be numbered
    places = spark.createDataFrame(rows, "environment string, subject string, start long, centres long").where("centres > 0")
    centres = places.select(*run, "start", F.explode(F.sequence(F.lit(0), F.col("centres") - 1)).alias("i"))
    centres = centres.where(evenly(F.col("start") + F.col("i"), F.lit(start), maximum)).select(*run, (F.col("i") + half).alias("frame"), F.lit(1).alias("stride"))
    frames = packed_frames(spark, root, part_bytes)
    frames = frames.select(*run, "frame", g.diagnostic_points(g.reordered(F.col("points"), g.POINT_ORDER)).alias("points"), g.reordered(F.col("pose"), g.POSE_ORDER).alias("pose"))
    windows = strided_windows(centres, frames.drop("pose"), run, width, "points", centre="frame", index="frame")
    whole = (F.col("n_frames") == width) & F.forall("frames", lambda f: F.size(f["points"]) > 0)
    poses = frames.where(F.forall("pose", lambda j: F.forall(j, g.is_finite))).select(*run, "frame", "pose")
    found = windows.where(whole).join(poses, [*run, "frame"])
    return found.select(*run, "frame", F.get("frames", F.lit(half))["points"].alias("points"), F.transform("frames", lambda f: f["points"]).alias("frames"), "pose")
