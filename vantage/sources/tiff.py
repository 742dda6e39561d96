"""Elevation images in stripped TIFF files, read in ranges of strips: a partition holds one strip at a time.

Whole numbers or floats of one sample a pixel, plain or deflated, in classic and big files of either
byte order. Tiled files are refused, as are other compressions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vantage.sources.files import opened

# Numbers of the format's tags, sizes of its types, its compressions and kinds of samples.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
_TYPES = {1: "u1", 3: "u2", 4: "u4", 16: "u8"}
PLAIN, DEFLATED = 1, (8, 32946)
_SAMPLES = {1: "u", 2: "i", 3: "f"}
#: Bytes of decoded strips in a partition, about, and pixels in a batch.
PART_BYTES, BATCH = 32 << 20, 1 << 20
SCHEMA = "row long, col long, feet double"


@dataclass
class Image:
    """What the head of a file says: size, number type, and where the strips are."""

    width: int
    height: int
    dtype: str
    deflated: bool
    differences: bool
    rows: int  # of a strip
    offsets: list[int]
    counts: list[int]


def read_head(path: str) -> Image:
    system, place = opened(path)
    with system.open_input_file(place) as file:
        start = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or len(start) < 8:
            raise ValueError(f"not a TIFF file: {path}")
        number = lambda data, kind, at: int(np.frombuffer(data, order + kind, 1, at)[0])
        big = {42: False, 43: True}.get(number(start, "u2", 2))
        if big is None:
            raise ValueError(f"not a TIFF file: {path}")
        word, entry, head = ("u8", 20, 8) if big else ("u4", 12, 2)
        at = number(start, word, 8 if big else 4)
        file.seek(at)
        entries = number(file.read(head), "u8" if big else "u2", 0)
        table, tags = file.read(entries * entry), {}
        for i in range(entries):
            tag, kind = number(table, "u2", entry * i), number(table, "u2", entry * i + 2)
            if kind not in _TYPES:
                continue
            count = number(table, word, entry * i + 4)
            size, place_of = np.dtype(_TYPES[kind]).itemsize * count, entry * i + (12 if big else 8)
            if size <= (8 if big else 4):
                data = table[place_of : place_of + size]
            else:
                file.seek(number(table, word, place_of))
                data = file.read(size)
            tags[tag] = np.frombuffer(data, order + _TYPES[kind], count).tolist()
    if TILE in tags or OFFSETS not in tags:
        raise ValueError(f"not an image of strips: {path}")
    one = lambda tag, default: tags.get(tag, [default])[0]
    compression, bits, kind = one(COMPRESSION, PLAIN), one(BITS, 1), one(FORMAT, 1)
    if one(SAMPLES, 1) != 1 or kind not in _SAMPLES or bits not in (8, 16, 32, 64) or not (compression == PLAIN or compression in DEFLATED) or one(PREDICTOR, 1) not in (1, 2) or (kind == 3 and one(PREDICTOR, 1) == 2):
        raise ValueError(f"an image of another kind (compression {compression}, {bits} bits, format {kind}): {path}")
    height = one(HEIGHT, 0)
    return Image(one(WIDTH, 0), height, f"{order}{_SAMPLES[kind]}{bits // 8}", compression != PLAIN, one(PREDICTOR, 1) == 2, min(one(ROWS, height), height), tags[OFFSETS], tags[COUNTS])


@dataclass
class Strips(InputPartition):
    path: str
    image: Image  # with the offsets and counts of these strips only
    first_row: int


def ranges(path: str, image: Image, first: int, end: int, size: int | None = None) -> list[Strips]:
    """Partitions of the strips from ``first`` to before ``end``, ``size`` in each (None: by bytes)."""
    strip = max(image.rows * image.width * np.dtype(image.dtype).itemsize, 1)
    step = size or max(PART_BYTES // strip, 1)
    out = []
    for i in range(first, end, step):
        j = min(i + step, end)
        own = Image(image.width, image.height, image.dtype, image.deflated, image.differences, image.rows, image.offsets[i:j], image.counts[i:j])
        out.append(Strips(path, own, i * image.rows))
    return out


def read_strips(part: Strips) -> Iterator[pa.RecordBatch]:
    image, row = part.image, part.first_row
    system, place = opened(part.path)
    with system.open_input_file(place) as file:
        for offset, count in zip(image.offsets, image.counts):
            file.seek(offset)
            data = file.read(count)
            rows = min(image.rows, image.height - row)
            pixels = np.frombuffer(zlib.decompress(data) if image.deflated else data, image.dtype, rows * image.width).reshape(rows, image.width)
            if image.differences:
                pixels = np.cumsum(pixels, axis=1, dtype=np.dtype(image.dtype).newbyteorder("="))
            step = max(BATCH // max(image.width, 1), 1)
            for i in range(0, rows, step):
                some = pixels[i : i + step]
                columns = [np.repeat(np.arange(row + i, row + i + len(some)), image.width), np.tile(np.arange(image.width), len(some)), some.ravel().astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["row", "col", "feet"])
            row += rows


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options["strips"]) if "strips" in options else None


class StripReader(_Options, DataSourceReader):
    def partitions(self) -> list[Strips]:
        image = read_head(self.path)
        return ranges(self.path, image, 0, len(image.offsets), self.size)

    def read(self, part: Strips | None) -> Iterator[pa.RecordBatch]:
        return read_strips(part) if part else iter(())


class StripStream(_Options, DataSourceStreamReader):
    """An image as a stream: the offset is the number of strips, so a restart goes on behind the last batch."""

    def initialOffset(self) -> dict:
        return {"strips": 0}

    def latestOffset(self) -> dict:
        return {"strips": len(read_head(self.path).offsets)}

    def partitions(self, start: dict, end: dict) -> list[Strips]:
        return ranges(self.path, read_head(self.path), start["strips"], end["strips"], self.size)

    def read(self, part: Strips | None) -> Iterator[pa.RecordBatch]:
        return read_strips(part) if part else iter(())


class StripSource(DataSource):
    """Format ``vantage_strips``: row (0 in the north), col and feet of an image's pixels; options path and strips (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "vantage_strips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> StripReader:
        return StripReader(dict(self.options))

    def streamReader(self, schema: object) -> StripStream:
        return StripStream(dict(self.options))


def read_image(spark: SparkSession, path: str, strips: int | None = None) -> DataFrame:
    """row, col, feet of all pixels of one image, in tasks of some strips each; feeds ``raster.retile_elevation``."""
    spark.dataSource.register(StripSource)
    reader = spark.read.format("vantage_strips")
    return (reader.option("strips", strips) if strips else reader).load(path)


def stream_image(spark: SparkSession, path: str, strips: int | None = None) -> DataFrame:
    """The same as a stream with the event time ``passed`` of each row; feeds ``refresh.stream_tiles``."""
    spark.dataSource.register(StripSource)
    reader = spark.readStream.format("vantage_strips")
    return (reader.option("strips", strips) if strips else reader).load(path).withColumn("passed", F.timestamp_seconds(F.col("row")))
