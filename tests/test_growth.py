"""Plans that hold on larger tables: work dealt out before it grows, no broadcast of exploded rows, few shuffles."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import raster, rooftop, terrain, zone
from vantage.plans import catalog, standins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """part and customer of 10,000 rows, each one file."""
    folder = tmp_path_factory.mktemp("tables")
    k = spark.range(10_000)
    k.select(F.col("id").alias("p_partkey"), F.lit("Brand#11").alias("p_brand"), (F.col("id") % 50).alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    k.select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def boxes(spark, rng, rows, *keep):
    corner = "e int, n int, w int, h int"
    return spark.createDataFrame([(*k, *map(int, xy), *map(int, wh)) for k, xy, wh in zip(keep[0], rng.integers(-300, 300, (rows, 2)), rng.integers(1, 40, (rows, 2)) * rng.choice([1, 1, 1, 9, 60], (rows, 1)))], f"id string, {corner}")


def test_small_tables_are_dealt_out_before_they_grow(spark, tables):
    for rows, each in ((standins.boxes(spark, tables), standins.BOXES), (standins.links(spark, tables), standins.LINKS)):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_000 and len(sizes) >= 10_000 // each and max(sizes) < 2 * each


def test_exploded_rows_are_not_broadcast(spark, tables):
    parts = standins.rings(standins.boxes(spark, tables)).withColumnRenamed("obstruction_id", "bin")
    cells = raster.rasterize(parts, "bin", "h_in")
    ground = spark.createDataFrame([(standins.EAST, standins.NORTH, 1)], "e int, n int, h_in int")
    assert "BroadcastHashJoin" not in plan(terrain.ground_under(parts.select("bin", "rings"), ground, "bin"))
    assert "BroadcastHashJoin" not in plan(terrain.without_footprint(cells, parts))


def test_roof_samples_are_not_broadcast(spark, tables):
    parts = standins.rings(standins.boxes(spark, tables)).withColumnsRenamed({"obstruction_id": "bin", "e": "sw_e", "n": "sw_n"})
    cells = raster.rasterize(parts, "bin", "h_in", "sw_e", "sw_n").withColumn("mask", F.lit(True))
    edge = rooftop.perimeter_samples(parts.select("bin", "rings"), cells, 4.0)
    assert "BroadcastHashJoin" not in plan(edge)
    assert "BroadcastHashJoin" not in plan(rooftop.cull_near(edge, edge, 2.0))
    grid = plan(rooftop.grid_samples(cells, 4))
    assert "Join" not in grid


def test_chunks_are_found_where_the_cells_are(spark, tables):
    held = standins.boxes(spark, tables)
    cells = raster.rasterize(standins.rings(held), "obstruction_id", "h_in")
    split = plan(terrain.split_large(held.select("obstruction_id", F.lit(1000).alias("w"), F.lit(1000).alias("h")), cells))
    assert "BroadcastHashJoin" not in split and split.count("Exchange hashpartitioning") == 2  # one for each side


def test_overlapping_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    a, b = (boxes(spark, rng, 150, [(f"{s}{i}",) for i in range(150)]) for s in "ab")
    a = a.unionByName(spark.createDataFrame([("wide", -2_000_000, -5, 4_000_000, 9), ("flat", 3, 3, 0, 4)], a.schema))
    found = terrain.overlapping(a.withColumnRenamed("id", "a"), b.withColumnRenamed("id", "b"), "a", "b")
    want = [(x.id, y.id) for x, y in itertools.product(a.collect(), b.collect()) if x.e < y.e + y.w and y.e < x.e + x.w and x.n < y.n + y.h and y.n < x.n + x.h]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 500


def test_small_boxes_meet_in_a_fine_grid(spark):
    spots = spark.range(300).select(F.col("id").alias("a"), *((F.col("id") % k * 20).cast("int").alias(x) for x, k in (("e", 25), ("n", 24))), F.lit(9).alias("w"), F.lit(9).alias("h"))
    met = terrain.overlapping(spots, spots.withColumnRenamed("a", "b"), "a", "b")
    assert met.count() == 300  # all in one 500-foot tile
    assert "cx#" in plan(met) and "ke#" not in plan(met)


def test_nearest_samples_of_many_roofs_in_one_group(spark):
    rng = np.random.default_rng(5)
    cells = [(f"r{r}", int(e), int(n)) for r in range(60) for e, n in {tuple(x) for x in rng.integers(0, 90, (40, 2)) + 7 * r}]
    samples = [(f"r{r}", float(x), float(y), (int(i), r), int(i) % 7) for r in range(0, 60, 2) for i, (x, y) in enumerate(np.round(rng.uniform(0, 90, (6, 2)) * 2) / 2 + 7 * r)]
    samples += [("r0", float("inf"), 0.0, (-1, 0), 9), ("r1", float("nan"), 0.0, (-1, 0), 9), ("alone", 1.0, 1.0, (0, 0), 9)]
    found = rooftop.nearest_status(spark.createDataFrame(cells, "bin string, e int, n int"), spark.createDataFrame(samples, "bin string, x double, y double, sample_id struct<a:int,b:int>, status int"), 4)
    want = []
    for roof, e, n in cells:
        own = [((x - e - 0.5) ** 2 + (y - n - 0.5) ** 2, i, s) for r, x, y, i, s in samples if r == roof and np.isfinite(x)]
        want += [(roof, e, n, min(own)[2])] if own else []
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "_group" in plan(found)


def test_roof_outliers_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(raster, "STRIP", 4)
    rng = np.random.default_rng(11)
    height = {("r", int(e), int(n)): int(h) for e, n, h in zip(rng.integers(-9, 9, 200), rng.integers(0, 14, 200), rng.choice([10, 20, 900], 200))}
    found = raster.replace_outliers(spark.createDataFrame([(*k, h) for k, h in height.items()], "bin string, e int, n int, h_in int"))
    assert plan(found).count("Exchange hashpartitioning") == 1
    got = {(r.bin, r.e, r.n): r.h_in for r in found.collect()}
    for (b, e, n), h in height.items():
        near = [height[b, e + i, n + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (b, e + i, n + j) in height]
        mean = sum(near) / len(near) if near else h
        assert got[b, e, n] == (int(mean + 0.5) if abs(h - mean) > 180 else h)
    assert len(got) == len(height)


def test_fingerprints_give_candidates_of_near_copies(spark, monkeypatch):
    from vantage.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # the sketch finds nothing here: copies are found by their fingerprints, and verified
    monkeypatch.setattr(simhash, "sketch", lambda hashes, least: (hashes[:0], np.zeros(simhash.SKETCH_WORDS, np.uint64)))
    near = np.bitwise_count(np.bitwise_xor(*simhash.simhashes([simhash.shingles(t, 3) for t in texts[:2]], 42)))
    assert near <= 2
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [0, 2]


def test_texts_stay_where_they_lie_while_the_sample_is_chosen(spark, monkeypatch):
    from vantage.llm import toxicity

    k = spark.range(3_000)
    docs = k.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("text "), F.col("id") % 50)).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 900"))
    labels = k.where("id % 3 > 0").select(F.col("id").alias("doc_id"), (F.col("id") % 4 - 1).alias("toxic"))
    labels = labels.unionByName(labels.where("doc_id < 300").withColumn("toxic", F.lit(1).cast("long")))
    fitted = []
    monkeypatch.setattr(toxicity, "_fit", lambda rows, *_: fitted.append(rows))
    for limit in (400, 100_000):
        toxicity.fit(docs.join(labels, "doc_id"), limit)
        toxicity.fit_joined(docs, labels, limit)
        want, got = (sorted(map(tuple, rows.collect())) for rows in fitted[-2:])
        assert got == want and len(want) > 200
    monkeypatch.setattr(toxicity, "_fit", lambda rows, *_: plan(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in toxicity.fit_joined(docs, labels, 400)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_zones_meet_squares_of_terrain_and_shuffle_no_cells(spark):
    rng = np.random.default_rng(12)
    ends = rng.uniform(-400, 400, (30, 2))
    steps = np.r_[rng.uniform(-300, 300, (26, 2)), [[0, 200], [200, 0], [0, 0], [-150, 0.01]]]
    rows = [(i, *map(float, (a[0], a[1], 10, a[0] + s[0], a[1] + s[1], 14, 3e9 if i % 2 else 60e9))) for i, (a, s) in enumerate(zip(ends, steps))]
    links = spark.createDataFrame(rows, "link_id long, ae double, an double, az double, be double, bn double, bz double, hertz double")
    ground = spark.createDataFrame([(int(e), int(n), int(e * 7 + n * 11) % 260 - 20) for e in range(-700, 700, 2) for n in range(-300, 300) if (e // 90 + n // 70) % 3], "e int, n int, h_in int")
    both = zone.zone_cells(links, zone.FULL).unionByName(zone.zone_cells(links, zone.INNER))
    keep = ["link_id", "alpha", "n", "e", "bottom", "top", "west", "terrain", "fraction"]
    want = sorted(map(tuple, zone.intersect(both, ground).select(*keep).collect()))
    got = zone.fractions(zone.over_terrain(links, ground, zone.FULL, zone.INNER)).select(*keep)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10_000
    for query in (zone.statuses(links, ground), zone.tile_overview(links, ground)):
        assert "pe#" in plan(query) and "Join [e#" not in plan(query)


def test_flattened_cells_stay_where_their_boxes_are(spark, tables):
    held = plan(catalog.QUERIES["footprint_flattened"](spark, tables))
    assert "BroadcastHashJoin" not in held and "ENSURE_REQUIREMENTS" not in held and held.count("REPARTITION_BY_NUM") == 2


def test_flattened_cells_are_those_inside(spark):
    ring = lambda *p: [[dict(zip("xy", map(float, q))) for q in (*p, p[0])]]
    rings = [("a", ring((-3.5, -2), (6, -4.25), (5, 7), (1, 1), (-4, 8))), ("b", ring((2, 2), (5, 2), (5, 5), (2, 5)))]
    polygons = spark.createDataFrame(rings, "bin string, rings array<array<struct<x:double,y:double>>>")
    cells = spark.createDataFrame([(b, e, n, 5) for b in "abc" for e in range(-8, 10) for n in range(-8, 12)], "bin string, e int, n int, h_in int")
    from vantage.functions import geometry

    inside = cells.join(polygons, "bin", "left").select("bin", "e", "n", F.when(geometry.contains(F.col("rings"), F.col("e").cast("double"), F.col("n").cast("double")), 0).otherwise(5).alias("h_in"))
    assert sorted(map(tuple, terrain.without_footprint(cells, polygons).select("bin", "e", "n", "h_in").collect())) == sorted(map(tuple, inside.collect()))


def test_masks_are_bits_of_runs(spark):
    rng = np.random.default_rng(15)
    shapes = [rng.uniform(-90, 90, (rng.integers(3, 7), 2)).round(int(rng.integers(0, 3))) for _ in range(12)] + [np.array([[0, 0], [40, 0], [40, 70.5], [0, 70.5]]), np.array([[-5.5, 3.5]] * 3)]
    rings = [(i, [[{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]]) for i, p in enumerate(shapes)]
    polygons = spark.createDataFrame(rings, "id int, rings array<array<struct<x:double,y:double>>>")
    for spans, cells in ((raster.near_spans(polygons, 5.0, "id"), raster.near_edges(polygons, 5.0, "id")), (raster.row_spans(polygons, "id"), raster.rasterize(polygons, "id"))):
        words = raster.packed_spans(spans, "id").collect()
        got = {(r.id, r.word * raster.WORD + bit, r.n) for r in words for bit in range(raster.WORD) if r.cells >> bit & 1}
        assert got == {(r.id, r.e, r.n) for r in cells.collect()} and len(got) > 5_000
        assert len(words) < len(got)


def test_roofs_meet_squares_of_elevation(spark):
    rng = np.random.default_rng(21)
    shapes = [rng.uniform(-100, 100, (rng.integers(3, 7), 2)).round(int(rng.integers(0, 3))) for _ in range(6)] + [np.array([[-62, -1.5], [62, -1.5], [62, 1], [-62, 1]]), np.array([[5.5, 3.5]] * 3)]
    rings = [(f"r{i}", [[{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]]) for i, p in enumerate(shapes)] + [("none", None)]
    polygons = spark.createDataFrame(rings, "bin string, rings array<array<struct<x:double,y:double>>>")
    tall = {(e, n): int(h) for (e, n), h in zip(itertools.product(range(-90, 120), range(-100, 62)), rng.choice([0, 100, 130, 900], 210 * 162))}
    found = rooftop.heightmap(polygons, spark.createDataFrame([(*k, h) for k, h in tall.items()], "e int, n int, h_in int"))
    assert not re.search(r"hashpartitioning\([^)]*\be#", plan(found))  # no cell is shuffled
    got = {(r.bin, r.e, r.n): (r["mask"], r.h_in, r.sw_e, r.sw_n) for r in found.collect()}
    moved = spark.createDataFrame([(k, [[{"x": p["x"] + 0.5, "y": p["y"] + 0.5} for p in shape[0]]]) for k, shape in rings[:-1]], polygons.schema)
    inside = raster.rasterize(moved, "bin").unionByName(raster.near_edges(moved, 0.5, "bin", touching=False))
    masks = {(r.bin, r.e, r.n) for r in inside.collect()}
    want = {}
    for i, p in enumerate(shapes):
        (west, south), (east, north) = np.floor(p.min(0)).astype(int), np.ceil(p.max(0)).astype(int)
        box = {(e, n) for e in range(west, east) for n in range(south, north)}
        own = {c: tall.get(c, 0) for c in box if (f"r{i}", *c) in masks}
        for e, n in box:
            near = [own[c] for c in itertools.product((e - 1, e, e + 1), (n - 1, n, n + 1)) if c in own and c != (e, n)]
            h = own.get((e, n), 0)
            mean = sum(near) / len(near) if near else h
            want[f"r{i}", e, n] = ((e, n) in own, int(mean + 0.5) if (e, n) in own and abs(h - mean) > 180 else h, west, south)
    assert got == want and len(got) > 50_000


def test_roof_samples_stay_with_their_roof(spark, tables):
    for query in (catalog.rooftop_samples, catalog.sample_grid, catalog.cliff_points, catalog.cull_near_perimeter):
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", plan(query(spark, tables)))
        assert dealt and all(keys.startswith("obstruction_id#") and by == "REPARTITION_BY_NUM" for keys, by in dealt)  # boxes alone


def test_edge_points_of_winding_roofs(spark):
    rng = np.random.default_rng(23)
    shapes = {f"r{i}": [rng.uniform(-30, 30, (rng.integers(3, 6), 2)).round(int(rng.integers(0, 3))) for _ in range(rng.integers(1, 4))] for i in range(8)}
    shapes["square"] = [np.array([[0, 0], [12, 0], [12, 12], [0, 12]])] * 2  # two rings of the same points
    closed = {b: [np.vstack([p, p[:1]]) for p in rings] for b, rings in shapes.items()}
    polygons = spark.createDataFrame([(b, [[{"x": float(x), "y": float(y)} for x, y in p] for p in rings]) for b, rings in closed.items()], "bin string, rings array<array<struct<x:double,y:double>>>")
    cells = {(b, int(e), int(n)): (int(h), bool(m)) for b in [*shapes, "alone"] for (e, n), h, m in zip(rng.integers(-28, 26, (1500, 2)), rng.integers(0, 999, 1500), rng.random(1500) < 0.4)}
    order = [(0, 0), *((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)]
    want = []
    for b, rings in closed.items():
        (west, south), (east, north) = (f([c[1:] for c in cells if c[0] == b], axis=0) for f in (np.min, np.max))
        for ring, p in enumerate(rings):
            until = np.cumsum(np.hypot(*np.diff(p, axis=0).T))
            for step in range(int(np.ceil(until[-1] / 2.5))):
                i = int(np.searchsorted(until, step * 2.5, "right"))
                t = (step * 2.5 - (until[i - 1] if i else 0)) / (until[i] - (until[i - 1] if i else 0))
                x, y = p[i] + t * (p[i + 1] - p[i])
                e, n = np.clip(np.floor(x), west, east), np.clip(np.floor(y), south, north)
                seen = [cells[b, e + k, n + m] for k, m in order if cells.get((b, e + k, n + m), (0, False))[1]]
                want += [(b, ring, step, seen[0][0])] if seen else []
    held = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "bin string, e int, n int, h_in int, mask boolean")
    edge = rooftop.perimeter_samples(polygons, held, 2.5)
    rows = edge.collect()
    assert sorted((r.bin, r.ring, r.step, r.h_in) for r in rows) == sorted(want) and len(want) > 300
    points = held.where("h_in % 8 = 0").select("bin", F.col("e").cast("double").alias("x"), (F.col("n") + 0.5).alias("y"), "h_in")
    points = points.unionByName(points.limit(3).withColumn("x", F.lit(None).cast("double"))).unionByName(points.limit(3).withColumn("bin", F.lit(None).cast("string")))
    for radius in (0.0, 1.25, 7.0):
        far = [p for p in points.collect() if p.x is None or all(r.bin != p.bin or (r.x - p.x) ** 2 + (r.y - p.y) ** 2 >= radius**2 for r in rows)]
        assert sorted(map(str, rooftop.cull_near(points, edge, radius).collect())) == sorted(map(str, far))
