"""LiDAR outliers, land shapefiles and links over stored tiles, against brute force and small files."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import city, lidar, raster, terrain, zone
from vantage.sources import las, shapefile

# LiDAR


def brute_means(points, wanted):
    files = {}
    for file, x, y, z in points:
        files.setdefault(file, []).append((x, y, z))
    out = {}
    for file, own in files.items():
        a = np.array(own)
        d = np.sort(np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)), 1)[:, 1 : wanted + 1]
        out[file] = [(p, float(row.mean()) if len(row) else None) for p, row in zip(own, d)]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    rows = []
    add = lambda file, xyz: rows.extend((file, *map(float, p)) for p in xyz)
    add("plain", rng.uniform(0, 40, (500, 3)) * [1, 1, 0.05])
    add("plain", [[20, 20, 300], [20, 20.5, 300], [-700, 4000, 3]])  # strays: two that are near each other, one far off
    add("plain", rng.uniform(20, 20.02, (150, 3)))  # a hot spot of different points
    add("copies", np.repeat(rng.uniform(0, 9, (20, 3)), [1, 2, 40, 14, 13, 12] + [3] * 14, axis=0))
    add("copies", [[900, 0, 0]])
    add("few", rng.uniform(0, 9, (7, 3)))
    add("one", [[1, 1, 1]])
    add("", rng.uniform(-9, 9, (30, 3)))
    add("wide", [[i * 500_000.0, 0, 0] for i in range(20)])
    return rows


def test_neighbour_distances(spark, cloud):
    df = spark.createDataFrame(cloud, "file string, x double, y double, z double")
    found = {(r.file, (r.x, r.y, r.z)): (r.copies, r["mean"]) for r in lidar.neighbour_distances(df).collect()}
    for file, own in brute_means(cloud, 12).items():
        for p, mean in own:
            got = found[file, p][1]
            assert (got is None and mean is None) or got == pytest.approx(mean, abs=1e-9), (file, p)
            assert found[file, p][0] == sum(q == p for q, _ in own)


def test_outliers_become_noise(spark, cloud):
    rows = [(*r, 2, i) for i, r in enumerate(cloud)] + [("plain", 20.0, 20.0, 900.0, 18, -1), ("plain", None, 1.0, 1.0, 2, -2), ("plain", math.nan, 1.0, 1.0, None, -3), (None, 0.0, 0.0, 0.0, None, -4)]
    marked = {r.id: r["class"] for r in lidar.mark_outliers(spark.createDataFrame(rows, "file string, x double, y double, z double, class int, id int")).collect()}
    assert len(marked) == len(rows) and [marked[i] for i in (-1, -2, -3, -4)] == [18, 2, None, None]
    want = set()
    for file, own in brute_means(cloud + [("", 0.0, 0.0, 0.0)], 12).items():
        means = [m for _, m in own if m is not None]
        if means:
            limit = np.mean(means) + 4 * (np.std(means, ddof=1) if len(means) > 1 else 0)
            want |= {(file, p) for p, m in own if m > limit}
    assert {(r[0], r[1:4]) for r, i in ((r, i) for i, r in enumerate(cloud)) if marked[i] == 7} == want
    assert ("plain", (-700.0, 4000.0, 3.0)) in want and ("copies", (900.0, 0.0, 0.0)) in want
    # the grid of heights no longer has the stray
    clean = lidar.mark_outliers(spark.createDataFrame(rows, "file string, x double, y double, z double, class int, id int").where("id >= 0"))
    assert raster.height_grid(clean.where("file = 'plain'")).where("e = -700").count() == 0


def test_outliers_of_nothing(spark):
    assert lidar.mark_outliers(spark.createDataFrame([], "file string, x double, y double, z double, class int")).count() == 0


# Shapefiles


def square(x, y, side, clockwise=True):
    ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    return ring if clockwise else ring[::-1]


def write_shapefile(path, records):
    """Records: lists of rings, or None for a point."""
    body, index = b"", b""
    for number, rings in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<idd", 1, 0.0, 0.0)
        else:
            points = [p for ring in rings for p in ring]
            starts = np.cumsum([0] + [len(r) for r in rings[:-1]]).tolist()
            box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
            content = struct.pack("<i4dii", 5, *box, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">ii", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">ii", number, len(content) // 2) + content
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    path.write_bytes(head(100 + len(body)) + body)
    path.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)


RECORDS = [
    [square(-74.0, 40.6, 0.1), square(-73.99, 40.61, 0.01, False), square(-73.95, 40.65, 0.01, False)],  # two holes
    [square(10, 50, 1)],  # far away
    None,
    [square(-74.2, 40.5, 0.05), square(-74.19, 40.51, 0.01, False), square(-74.1, 40.5, 0.02)],  # a hole, then another part
    [square(-73.9, 40.7, 0.02, False), square(-73.92, 40.68, 0.1)],  # the hole comes first
    [square(-73.8, 40.7, 0.02, False)],  # only a hole
    [square(-73.5, 40.5, 0.1)],  # touches the city's box only
]


@pytest.fixture(scope="module")
def land(tmp_path_factory):
    path = tmp_path_factory.mktemp("land") / "land.shp"
    write_shapefile(path, RECORDS)
    write_shapefile(path.with_name("none.shp"), [])
    return path


@pytest.mark.parametrize("records", [1, 3, 100])
def test_shapefile_rings(spark, land, records):
    df = shapefile.read_polygons(spark, str(land), records=records)
    assert df.rdd.getNumPartitions() == math.ceil(len(RECORDS) / records)
    rows = {(r.record, r.part): [[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.collect()}
    assert rows == {
        (1, 0): RECORDS[0], (2, 0): RECORDS[1], (4, 0): RECORDS[3][:2], (4, 1): RECORDS[3][2:], (5, 0): RECORDS[4][::-1], (7, 0): RECORDS[6],
    }


def test_shapefile_folder_and_nothing(spark, land):
    assert shapefile.read_polygons(spark, str(land.parent)).count() == 6 and shapefile.read_polygons(spark, str(land.with_name("none.shp"))).count() == 0
    assert shapefile.read_polygons(spark, land.as_uri()).count() == 6


def test_records_outside_are_not_decoded(spark, land, monkeypatch):
    seen = []
    monkeypatch.setattr(shapefile, "assembled", lambda points, starts: seen.append(len(points)) or [])
    reader = shapefile.ShapefileReader({"path": str(land), "box": "-74.4,40.3,-73.5,41.1"})
    list(reader.read(reader.partitions()[0]))
    assert len(seen) == 4
    filtering = shapefile.FilteringShapefileReader({"path": str(land)})
    left = list(filtering.pushFilters([shapefile.GreaterThan(("east",), 5.0), shapefile.LessThan(("part",), 1)]))
    assert [f.attribute for f in left] == [("part",)]
    list(filtering.read(filtering.partitions()[0]))
    assert len(seen) == 5


def test_filters_reach_the_source(spark, land):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = shapefile.read_polygons(spark, str(land)).where("west > 0 AND part = 0")
        assert [r.record for r in df.collect()] == [2]
        assert "> 0.0" not in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # the source has tested it
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_land_in_feet_feeds_the_classes(spark, land, tmp_path):
    shapes = shapefile.read_land(spark, str(land)).collect()
    assert len(shapes) == 4 and all(900_000 < p.x < 1_100_000 and 100_000 < p.y < 300_000 for s in shapes for ring in s.rings for p in ring)
    write_shapefile(tmp_path / "small.shp", [[square(-74.0, 40.6, 0.001), square(-73.9998, 40.6002, 0.0003, False)]])
    df = shapefile.read_land(spark, str(tmp_path / "small.shp"))
    corner, hole = (df.select(F.expr(f"rings[{i}][0]").alias("p")).first().p for i in (0, 1))
    places = [(int(corner.x) + 10, int(corner.y) + 10), (int(hole.x) + 20, int(hole.y) + 20), (int(corner.x) - 20, int(corner.y) + 20)]
    grid = spark.createDataFrame([(e, n, 10.0, 0.0) for e, n in places], "e int, n int, height double, veg double")
    none = spark.createDataFrame([], df.schema)
    classes = {(r.e, r.n): r["class"] for r in raster.class_grid(grid, none, none, none, df).collect()}
    assert [classes[p] for p in places] == [raster.NONE, raster.WATER, raster.WATER]


# Links over tiles


def links(spark):
    rows = [(1, 1000010.0, 235010.0, 20.0, 1000110.0, 235060.0, 30.0), (2, 1000450.0, 235450.0, 20.0, 1000560.0, 235555.0, 22.0), (3, 1001960.0, 235010.0, 20.0, 1002040.0, 235020.0, 20.0)]
    return spark.createDataFrame([(*r, 60e9) for r in rows], "link_id int, ae double, an double, az double, be double, bn double, bz double, hertz double")


@pytest.fixture(scope="module")
def ground(spark):
    i, k = F.col("id") % 700, F.floor(F.col("id") / 700)
    cells = spark.range(700 * 700).select((F.lit(1000000) + i).cast("int").alias("e"), (F.lit(235000) + k).cast("int").alias("n"))
    return cells.withColumn("h_in", F.when((F.col("e") * 7 + F.col("n") * 3) % 41 == 0, 255).otherwise(F.col("e") % 200).cast("int"))


@pytest.fixture(scope="module")
def stored(spark, ground, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles") / "held")
    far = ground.where("e < 1000040 AND n < 235040").withColumn("e", F.col("e") + 50_000)
    raster.split_tiles(ground.unionByName(far).withColumn("class", F.lit(0))).write.partitionBy("ke", "kn").parquet(path)
    return spark.read.parquet(path)


def city_of(spark, wide):
    return spark.createDataFrame([(2000 + i, 470 + j) for i in range(wide) for j in range(wide)], "ke int, kn int")


def test_statuses_by_tile_are_those_of_cells(spark, ground, stored):
    want = {tuple(r) for r in zone.statuses(links(spark), ground).collect()}
    assert {tuple(r) for r in city.statuses(links(spark), stored, city_of(spark, 9)).collect()} == want
    cells = {(r.link_id, r.alpha, r.n, r.e, r.bottom, r.top, r.terrain) for r in city.zone_terrain(links(spark), stored).collect()}
    both = zone.zone_cells(links(spark), zone.FULL).unionByName(zone.zone_cells(links(spark), zone.INNER))
    assert cells == {(r.link_id, r.alpha, r.n, r.e, r.bottom, r.top, r.terrain) for r in zone.intersect(both, ground).collect()}


def test_a_link_that_leaves_the_city_fails(spark, stored):
    got = {r.link_id: (r.result == city.OUTSIDE, r.max_full is None) for r in city.statuses(links(spark), stored, city_of(spark, 4)).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (True, True)}
    nowhere = city.statuses(links(spark), stored, spark.createDataFrame([], "ke int, kn int"))
    assert {r.result for r in nowhere.collect()} == {city.OUTSIDE}


def test_tiles_that_are_not_held_are_flat(spark, stored):
    rows = city.statuses(links(spark).where("link_id = 3"), stored, city_of(spark, 9)).collect()
    assert [(r.result, r.max_full) for r in rows] == [("Unobstructed", 0)]


def test_other_tiles_are_not_read(spark, stored):
    one = links(spark).where("link_id = 1")
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.reuseBroadcastOnly", "false")
    try:
        df = city.tile_rows(zone.zone_tiles(one), stored)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan.lower()
        assert {(r.ke, r.kn) for r in df.select("ke", "kn").distinct().collect()} == {(2000, 470)}
    finally:
        spark.conf.unset("spark.sql.optimizer.dynamicPartitionPruning.reuseBroadcastOnly")


def test_city_from_an_outline(spark, stored):
    outline = spark.createDataFrame([([[(1000000.0, 235000.0), (1002000.0, 235000.0), (1002000.0, 237000.0), (1000000.0, 237000.0), (1000000.0, 235000.0)]],)], "rings array<array<struct<x:double,y:double>>>")
    got = {r.link_id: r.result for r in city.statuses(links(spark), stored, terrain.city_tiles(outline)).collect()}
    assert got[3] == city.OUTSIDE and got[1] != city.OUTSIDE


# LAS


def write_las(path, points, minor=2, kind=0):
    """Points x, y, z (hundredths of a foot from the offset) and class."""
    size, place = (30, 16) if kind >= 6 else (20, 15)
    head = bytearray(375 if minor >= 4 else 227)
    head[:4], head[25], head[104] = b"LASF", minor, kind
    struct.pack_into("<I", head, 96, len(head))
    struct.pack_into("<H", head, 105, size)
    struct.pack_into("<Q" if kind >= 6 else "<I", head, 247 if kind >= 6 else 107, len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 1000000.0, 240000.0, 0.0)
    body = b""
    for x, y, z, c in points:
        row = bytearray(size)
        struct.pack_into("<3i", row, 0, x, y, z)
        row[place] = c
        body += bytes(row)
    path.write_bytes(bytes(head) + body)


@pytest.mark.parametrize(("minor", "kind"), [(2, 0), (4, 6)])
def test_a_file_is_read_in_several_tasks(spark, tmp_path, minor, kind):
    points = [(i * 150, i * 70, i, i % 9) for i in range(25)]
    write_las(tmp_path / "240.las", points, minor, kind)
    write_las(tmp_path / "2240.las", [], minor, kind)
    df = las.read_las(spark, str(tmp_path), points=10)
    assert df.rdd.getNumPartitions() == 3
    got = {(round(r.x, 2), round(r.y, 2), round(r.z, 2), r["class"], r.file) for r in df.collect()}
    assert got == {(round(1000000 + x / 100, 2), round(240000 + y / 100, 2), z / 100, c, "240") for x, y, z, c in points}
    with pytest.raises(ValueError):
        las.read_head(str(tmp_path / "none.las") if (tmp_path / "none.las").write_bytes(b"x" * 400) else "")


def test_points_beside_their_tile_do_not_count(spark):
    rows = [(1000000.0, 240000.0, "240"), (1002499.9, 242499.9, "240"), (1002500.0, 240000.0, "240"), (999999.9, 240000.0, "240"), (1000000.0, 239999.0, "240")]
    got = raster.within_file(spark.createDataFrame(rows, "x double, y double, file string")).collect()
    assert [(r.x, r.y) for r in got] == [(1000000.0, 240000.0), (1002499.9, 242499.9)]
    with pytest.raises(Exception, match="not named after a tile"):
        raster.within_file(spark.createDataFrame([(1.0, 1.0, "x")], "x double, y double, file string")).collect()
