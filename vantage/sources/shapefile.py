"""Polygons of ESRI shapefiles, read in ranges of records planned from the index (.shx).

Each record begins with its bounding box, so a record outside the asked box is passed over before its
points are decoded: by the option ``box`` (west,south,east,north), or by filters on the columns west,
south, east and north that Spark hands over (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from vantage.functions import projection
from vantage.sources.files import opened

# Bytes of a file's and a record's head, the kind of plain polygons, and the city's box in degrees.
FILE_HEAD, RECORD_HEAD, POLYGON, CITY_BOX = 100, 8, 5, (-74.4, 40.3, -73.5, 41.1)
#: Records in a partition, and records in a batch.
RECORDS, BATCH = 20_000, 500
_POINT = "struct<x: double, y: double>"
SCHEMA = f"record long, part int, west double, south double, east double, north double, rings array<array<{_POINT}>>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_ARROW = pa.schema([("record", pa.int64()), ("part", pa.int32()), *((c, pa.float64()) for c in ("west", "south", "east", "north")), ("rings", _RINGS)])
_TESTS = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
_BOX = ("west", "south", "east", "north")


def _files(path: str) -> list[str]:
    """The .shp files of a folder, or the file itself."""
    system, place = opened(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.lower().endswith(".shp"))
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _index_of(path: str) -> str:
    return path[:-4] + (".SHX" if path.endswith("SHP") else ".shx")


def assembled(points: np.ndarray, starts: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons of a record's rings: each clockwise ring begins one, and the others after it are its holes.

    Holes before the first clockwise ring are its own; without any clockwise ring there is no polygon.
    """
    polygons: list[list[np.ndarray]] = []
    waiting: list[np.ndarray] = []
    for ring in np.split(points, starts[1:]):
        x, y = ring[:, 0], ring[:, 1]
        if np.sum((np.roll(x, -1) - x) * (np.roll(y, -1) + y)) > 0:
            polygons.append([ring, *waiting])
            waiting = []
        elif polygons:
            polygons[-1].append(ring)
        else:
            waiting.append(ring)
    return polygons


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("records", RECORDS))
        #: Conditions that a record's box has to meet: place in the box, comparison, number.
        self.tests: list[tuple[int, type, float]] = []
        if "box" in options:
            west, south, east, north = map(float, options["box"].split(","))
            self.tests = [(0, LessThan, east), (1, LessThan, north), (2, GreaterThan, west), (3, GreaterThan, south)]

    def partitions(self) -> list[Records]:
        out = []
        for path in _files(self.path):
            system, place = opened(_index_of(path))
            count = (system.get_file_info(place).size - FILE_HEAD) // 8
            out += [Records(path, first, min(self.size, count - first)) for first in range(0, count, self.size)]
        return out

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there is no partition
            return
        system, place = opened(_index_of(part.path))
        with system.open_input_file(place) as index:
            index.seek(FILE_HEAD + 8 * part.first)
            offsets, lengths = np.frombuffer(index.read(8 * part.count), ">i4").reshape(-1, 2).T.astype(np.int64) * 2
        system, place = opened(part.path)
        rows: list[tuple] = []
        with system.open_input_file(place) as file:
            for number, (offset, length) in enumerate(zip(offsets.tolist(), lengths.tolist()), part.first + 1):
                file.seek(offset + RECORD_HEAD)
                head = file.read(min(length, 44))
                if len(head) < 44 or int.from_bytes(head[:4], "little") != POLYGON:
                    continue
                box = np.frombuffer(head, "<f8", 4, 4)
                if not all(_TESTS[test](box[i], value) for i, test, value in self.tests):
                    continue
                parts, count = np.frombuffer(head, "<i4", 2, 36).tolist()
                rest = file.read(length - 44)
                points = np.frombuffer(rest, "<f8", 2 * count, 4 * parts).reshape(-1, 2)
                for i, polygon in enumerate(assembled(points, np.frombuffer(rest, "<i4", parts))):
                    rows.append((number, i, *box.tolist(), [[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon]))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class FilteringShapefileReader(ShapefileReader):
    """The same with filters that Spark hands over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _BOX:
                self.tests.append((_BOX.index(f.attribute[0]), type(f), float(f.value)))
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ShapefileSource(DataSource):
    """Format ``vantage_shapefile``: record, part, the record's box (west, south, east, north) and rings of each polygon.

    Options: path (a .shp file with its .shx beside it, or a folder of them), box, records (in a
    partition), filters ("true": take Spark's). Records of other kinds than plain polygons are passed
    over; an empty file gives no row. A task holds one record and a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "vantage_shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ShapefileReader:
        return (FilteringShapefileReader if self.options.get("filters") == "true" else ShapefileReader)(dict(self.options))


def read_polygons(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = RECORDS) -> DataFrame:
    """Polygons of shapefiles in their own coordinates; ``box``: only records whose box shares an inner point with it."""
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format("vantage_shapefile").option("records", records)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("filters", "true")
    return (reader.option("box", ",".join(map(repr, box))) if box else reader).load(path)


def read_land(spark: SparkSession, path: str, box: tuple[float, float, float, float] = CITY_BOX) -> DataFrame:
    """rings in plane feet of the land polygons (degrees) near the city; others are dropped before they are projected, which holds only here."""
    plane = lambda p: projection.to_plane(p["y"], p["x"], F.lit(0.0))
    point = lambda f: F.struct(f["easting"].alias("x"), f["northing"].alias("y"))
    return read_polygons(spark, path, box).select(F.transform("rings", lambda ring: F.transform(ring, lambda p: point(plane(p)))).alias("rings"))
