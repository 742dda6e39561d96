"""Stripped images: heads and strips of small files, as tables and as streams."""

import struct
import zlib

import numpy as np
import pytest

from vantage.operators import raster
from vantage.sources import tiff
from vantage.streaming import refresh


def write_tiff(path, pixels, rows=3, deflated=False, differences=False, order="<", big=False, extra=()):
    height, width = pixels.shape
    data = pixels.astype(pixels.dtype.newbyteorder(order))
    if differences:
        data = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1).astype(data.dtype)
    strips = [data[i : i + rows].tobytes() for i in range(0, height, rows)]
    strips = [zlib.compress(s) for s in strips] if deflated else strips
    word, kind = ("Q", 16) if big else ("I", 4)
    head = 16 if big else 8
    offsets = np.cumsum([head] + [len(s) for s in strips[:-1]]).tolist()
    at = head + sum(map(len, strips))
    sample = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags = {256: [width], 257: [height], 258: [8 * pixels.dtype.itemsize], 259: [8 if deflated else 1], 273: offsets, 277: [1], 278: [rows], 279: [len(s) for s in strips], 317: [2 if differences else 1], 339: [sample], **dict(extra)}
    entry = 20 if big else 12
    arrays_at, table, arrays = at + (8 if big else 2) + entry * len(tags) + (8 if big else 4), b"", b""
    for tag, values in sorted(tags.items()):
        packed = struct.pack(f"{order}{len(values)}{word}", *values)
        table += struct.pack(f"{order}HH{word}", tag, kind, len(values))
        if len(values) == 1:
            table += packed
        else:
            table += struct.pack(f"{order}{word}", arrays_at + len(arrays))
            arrays += packed
    start = struct.pack(f"{order}HHHQ" if big else f"{order}HI", *((43, 8, 0, at) if big else (42, at)))
    path.write_bytes((b"II" if order == "<" else b"MM") + start + b"".join(strips) + struct.pack(order + ("Q" if big else "H"), len(tags)) + table + bytes(8 if big else 4) + arrays)
    return str(path)


@pytest.fixture(scope="module")
def heights():
    return np.random.default_rng(2).integers(-50, 900, (11, 7)).astype(np.int32)


def cells(df):
    return {(r.row, r.col): r.feet for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"deflated": True}, {"deflated": True, "differences": True}, {"order": ">"}, {"order": ">", "big": True, "deflated": True, "differences": True}, {"rows": 50}])
def test_pixels_come_back(tmp_path, heights, how):
    path = write_tiff(tmp_path / "a.tif", heights, **how)
    reader = tiff.StripReader({"path": path, "strips": "2"})
    got = {}
    for part in reader.partitions():
        for batch in reader.read(part):
            got |= {(r, c): f for r, c, f in zip(*(batch.column(i).to_pylist() for i in range(3)))}
    assert got == {(i, j): float(heights[i, j]) for i in range(11) for j in range(7)}


def test_other_numbers_and_kinds(tmp_path, heights):
    for dtype in ("u1", "u2", "f4", "f8"):
        own = np.abs(heights % 200).astype(dtype)
        part = tiff.StripReader({"path": write_tiff(tmp_path / f"{dtype}.tif", own)}).partitions()
        assert sum(b.column(2).to_numpy().sum() for p in part for b in tiff.read_strips(p)) == own.sum(dtype=np.float64)
    for extra in ({322: [16]}, {259: [5]}, {277: [3]}):
        with pytest.raises(ValueError):
            tiff.read_head(write_tiff(tmp_path / "bad.tif", heights, extra=extra.items()))
    (tmp_path / "no.tif").write_bytes(b"text")
    with pytest.raises(ValueError):
        tiff.read_head(str(tmp_path / "no.tif"))


def test_an_image_in_several_tasks(spark, tmp_path, heights):
    path = write_tiff(tmp_path / "a.tif", heights, deflated=True)
    df = tiff.read_image(spark, path, strips=1)
    assert df.rdd.getNumPartitions() == 4 and cells(df) == {(i, j): float(heights[i, j]) for i in range(11) for j in range(7)}


def test_tiles_from_strips_and_from_a_stream(spark, tmp_path):
    image = np.zeros((900, 20), np.int32)
    image[0, 0], image[450, 10], image[899, 19] = 7, 30, 2
    path = write_tiff(tmp_path / "a.tif", image, rows=100, deflated=True)
    west, north = 1_000_495, 235_300
    want = {tuple(r) for r in raster.retile_elevation(tiff.read_image(spark, path), west, north).where("h_in > 0").select("ke", "kn", "e", "n", "h_in").collect()}
    assert len(want) == 3
    stream = refresh.stream_tiles(tiff.stream_image(spark, path, strips=2), west, north)
    query = stream.writeStream.format("memory").queryName("strip_tiles").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()  # and once more, as the watermark has moved on
    finally:
        query.stop()
    got = {(r.ke, r.kn, c.e, c.n, c.h_in) for r in spark.table("strip_tiles").collect() for c in r.cells if c.h_in}
    assert got and got <= want  # the last band waits for rows south of it
