"""LiDAR points from uncompressed LAS files, in tasks of ranges of points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vantage.sources.files import opened

#: Points of a partition and of a batch.
POINTS, POINTS_PER_BATCH = 4_000_000, 250_000
SCHEMA = "x double, y double, z double, class int, file string"
_ARROW = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("class", pa.int32()), ("file", pa.string())])
#: Bytes of the longest public head (1.4).
HEAD = 375


@dataclass
class Points(InputPartition):
    """A range of a file's points, and how they are stored."""

    path: str
    start: int  # the first byte of the range
    size: int  # bytes of a point
    kind: int
    count: int
    scale: list[float]
    offset: list[float]


def read_head(path: str) -> Points:
    """All points of a file, by the public LAS 1.0-1.4 head."""
    system, place = opened(path)
    with system.open_input_file(place) as file:
        data = file.read(HEAD)
    if data[:4] != b"LASF" or len(data) < 227:
        raise ValueError(f"not a LAS file: {path}")
    start, kind, size = (int(np.frombuffer(data, t, 1, at)[0]) for t, at in (("<u4", 96), ("u1", 104), ("<u2", 105)))
    if kind & 0x80:
        raise ValueError(f"compressed points aren't read: {path}")
    long = data[25] >= 4 and kind >= 6
    count = int(np.frombuffer(data, "<u8", 1, 247)[0]) if long else int(np.frombuffer(data, "<u4", 1, 107)[0])
    return Points(path, start, size, kind, count, np.frombuffer(data, "<f8", 3, 131).tolist(), np.frombuffer(data, "<f8", 3, 155).tolist())


def ranges(whole: Points, points: int) -> list[Points]:
    return [
        Points(whole.path, whole.start + first * whole.size, whole.size, whole.kind, min(points, whole.count - first), whole.scale, whole.offset) for first in range(0, whole.count, points)
    ]


def read_points(part: Points) -> Iterator[pa.RecordBatch]:
    place, bits = (16, 0xFF) if part.kind >= 6 else (15, 0x1F)
    name = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    system, at = opened(part.path)
    with system.open_input_file(at) as file:
        file.seek(part.start)
        for first in range(0, part.count, POINTS_PER_BATCH):
            n = min(POINTS_PER_BATCH, part.count - first)
            rows = np.frombuffer(file.read(n * part.size), np.uint8, n * part.size).reshape(n, part.size)
            xyz = np.ascontiguousarray(rows[:, :12]).view("<i4") * np.array(part.scale) + np.array(part.offset)
            columns = [*(pa.array(xyz[:, i]) for i in range(3)), pa.array((rows[:, place] & bits).astype(np.int32)), pa.array([name]).take(pa.array(np.zeros(n, np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _files(path: str) -> list[str]:
    """The .las files of a folder, or the file itself."""
    system, place = opened(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.lower().endswith(".las"))
    return [f"{path.rstrip('/')}/{name}" for name in names]


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.points = options["path"], int(options.get("points", POINTS))

    def partitions(self) -> list[Points]:
        return [part for path in _files(self.path) for part in ranges(read_head(path), self.points)]

    def read(self, part: Points | None) -> Iterator[pa.RecordBatch]:
        return read_points(part) if part else iter(())


class LasSource(DataSource):
    """Format ``vantage_las``: points of a file or a folder of files; options path and points (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "vantage_las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LasReader:
        return LasReader(dict(self.options))


def read_las(spark: SparkSession, path: str, points: int = POINTS) -> DataFrame:
    """x, y, z, class and file (its name without the end) of the points under ``path``; a task holds a batch of its range."""
    spark.dataSource.register(LasSource)
    return spark.read.format("vantage_las").option("points", points).load(path)
