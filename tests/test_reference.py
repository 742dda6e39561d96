"""Operators of the line-of-sight system on literal cases and small grids, and queries against DuckDB."""

import datetime
import json
import math
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vantage.functions import geometry, normalize, projection, tiles
from vantage.operators import filings, raster, rooftop, terrain, zone
from vantage.plans import catalog
from vantage.sources import geo, las, sinks, tables
from vantage.streaming import refresh

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_headers():
    assert [normalize.column_name(h) for h in ("C/O Issuance Date", " BIN #", "the_geom")] == ["c_o_issuance_date", "bin", "the_geom"]


@pytest.mark.parametrize(("text", "number"), [("$1,234.56", 1234.56), ("  7 ", 7.0), ("N/A", None), ("", None), (None, None)])
def test_numbers(spark, text, number):
    assert value(spark, normalize.parse_number(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize(
    "text", ["09/02/2025", "2025-09-02", "09/02/25  1:24:22 PM", "9/2/25 1:24 PM", "09/02/2025 13:24:22", "09/02/2025 01:24:22 PM", "2025-09-02T13:24:22.123", "2025-09-02T13:24:22", "2025-09-02 13:24:22", "09/02/2025 13:24"]
)
def test_dates(spark, text):
    assert value(spark, normalize.parse_date(F.lit(text))) == datetime.date(2025, 9, 2)


@pytest.mark.parametrize("text", ["", "soon", "13/45/2025", None])
def test_no_dates(spark, text):
    assert value(spark, normalize.parse_date(F.lit(text).cast("string"))) is None


@pytest.mark.parametrize(
    ("parts", "bbl"), [(("1", "123", "45"), "1001230045"), ((" 3 ", "1,234", "7"), "3012340007"), (("6", "1", "1"), None), (("x", "1", "1"), None), (("1", "", "1"), None), (("1", "123456", "1"), "11234560001")]
)
def test_lot_numbers(spark, parts, bbl):
    assert value(spark, normalize.build_bbl(*map(F.lit, parts))) == bbl


def test_lot_parts(spark):
    assert tuple(value(spark, normalize.parse_bbl(F.lit("1001230045")))) == (1, "00123", "0045")
    assert value(spark, normalize.parse_bbl(F.lit("100123004"))) is None


def test_boroughs(spark):
    assert [value(spark, normalize.borough_number(F.lit(n))) for n in (" bronx", "QS", "SI", "Jersey")] == [2, 4, 5, None]


@pytest.mark.parametrize(("feet", "inches"), [(2.5 / 12, 3), (-1.0, 0), (1e6, 65535), (10.0, 120), (None, None)])
def test_inches(spark, feet, inches):
    assert value(spark, normalize.inches(F.lit(feet).cast("double"))) == inches


@pytest.mark.parametrize(("share", "byte"), [(0.0, 0), (-1.0, 0), (1.0, 255), (2.0, 255), (0.5, 128), (1e-9, 1)])
def test_fraction_bytes(spark, share, byte):
    assert value(spark, normalize.fraction_byte(F.lit(share))) == byte


@pytest.mark.parametrize(("name", "corner"), [("2152", (1002500, 152500)), ("987177", (987500, 177500)), ("200300", (1200000, 300000)), ("37", (1000000, 37500))])
def test_las_names(spark, name, corner):
    at = tiles.parse_las_name(F.lit(name))
    assert (value(spark, tiles.component_feet(at["e"])), value(spark, tiles.component_feet(at["n"]))) == corner
    assert value(spark, tiles.las_name(at["e"], at["n"])) == name


@pytest.mark.parametrize("name", ["", "12a", "1234567", "213", "203", "-27"])
def test_bad_las_names(spark, name):
    assert value(spark, tiles.parse_las_name(F.lit(name))) is None


def test_ortho_names(spark):
    assert value(spark, tiles.ortho_name(F.lit("37"))) == "000037.jp2"


def test_tiles_round_a_corner(spark):
    cells = spark.createDataFrame([(1002498 + i, 244998 + j) for i in range(4) for j in range(4)], "e int, n int")
    names = cells.select(tiles.tile_id(tiles.tile_key(F.col("e")), tiles.tile_key(F.col("n"))).alias("t")).distinct()
    assert {r.t for r in names.collect()} == {"242_44", "245_40", "2245_00", "2242_04"}


@pytest.mark.parametrize(("bottom", "top", "terrain_in", "share"), [(10, 20, 25, 1.0), (10, 20, 20, 1.0), (10, 20, 5, 0.0), (10, 20, 10, 0.0), (0, 100, 50, 0.5), (10, 10, 11, 1.0), (10, 10, 5, 0.0), (10, 10, 10, 1.0)])
def test_occlusion(spark, bottom, top, terrain_in, share):
    assert value(spark, zone.occlusion(F.lit(bottom), F.lit(top), F.lit(terrain_in))) == share


def link(spark, a, b, hertz):
    return spark.createDataFrame([(1, *map(float, a), *map(float, b), float(hertz))], "link_id long, ae double, an double, az double, be double, bn double, bz double, hertz double")


def test_axes(spark):
    d = 70145.8501170563
    row = zone.link_shapes(link(spark, (0, 0, 0), (d / math.sqrt(2), d / math.sqrt(2), 0), 5e9), 0.8).first()
    assert row.major == pytest.approx(35072.97423698255, rel=1e-6) and row.minor == pytest.approx(46.987075610800986, rel=1e-6)


def test_zone_holds_the_line(spark):
    """Cells next to the middle of the line are inside, between bottom and top; and the inner zone in the full one."""
    links = link(spark, (1000000, 240000, 100), (1000300, 240200, 160), 5e9)
    full = {(r.e, r.n): (r.bottom, r.top) for r in zone.zone_cells(links).collect()}
    inner = {(r.e, r.n): (r.bottom, r.top) for r in zone.zone_cells(links, 0.6).collect()}
    low, high = full[(1000150, 240100)]
    assert low <= 130 * 12 <= high and set(inner) <= set(full)
    assert all(full[k][0] <= lo + 1 and hi <= full[k][1] + 1 for k, (lo, hi) in inner.items())


def test_zone_matches_the_matrix_form(spark):
    """Every row's ends satisfy the ellipsoid's equation projected on the ground."""
    links = link(spark, (1000000, 240000, 50), (1000400, 240900, 90), 1e9)
    shape = zone.link_shapes(links).first()
    rows = {r.n: (r.e_lo, r.e_hi) for r in zone.zone_rows(links).collect()}
    u, a, b = (shape.ue, shape.un, shape.uz), shape.major, shape.minor
    # the shadow of an ellipsoid of revolution: variances b^2 + (a^2 - b^2) u_i u_j
    see, snn, sen = (b * b * (i == j) + (a * a - b * b) * u[i] * u[j] for i, j in ((0, 0), (1, 1), (0, 1)))
    det = see * snn - sen * sen

    def inside(e, n):
        x, y = e - shape.me, n - shape.mn
        return (snn * x * x - 2 * sen * x * y + see * y * y) / det <= 1 + 1e-9

    assert rows
    for n, (lo, hi) in rows.items():
        assert inside(lo, n) and inside(hi, n) and not inside(lo - 1, n) and not inside(hi + 1, n)


def test_status_turns_with_the_wall(spark):
    links = link(spark, (1000000, 240000, 100), (1000100, 240060, 100), 60e9)
    nothing = spark.createDataFrame([], "e int, n int, h_in int")
    assert zone.statuses(links, nothing).first().result == "Unobstructed"
    wall = spark.createDataFrame([(1000000 + i, 240030, 2000) for i in range(120)], "e int, n int, h_in int")
    row = zone.statuses(links, wall).first()
    assert (row.result, row.max_full, row.max_inner) == ("Obstructed", 255, 255)
    found = zone.tile_overview(links, wall).collect()
    assert [r.tile_id for r in found if r.detected] == [r.tile_id for r in found] and len(found) == 1


def test_five_gigahertz_axes_straight_east(spark):
    rows = zone.zone_rows(link(spark, (1000000, 240000, 50), (1000500, 240000, 50), 5e9)).collect()
    assert rows and all(r.e_lo <= r.e_hi for r in rows)


def test_projection(spark):
    row = spark.range(1).select(projection.to_plane(F.lit(40.7850341), F.lit(-73.9633981), F.lit(55.0)).alias("p")).select("p.*").first()
    assert (row.easting, row.northing) == (pytest.approx(994386.443, abs=6), pytest.approx(225285.050, abs=6)) and row.altitude == pytest.approx(180.446, abs=1)
    back = spark.range(1).select(projection.to_degrees(F.lit(row.easting), F.lit(row.northing), F.lit(row.altitude)).alias("g")).select("g.*").first()
    assert (back.lat, back.lon, back.alt_m) == (pytest.approx(40.7850341, abs=1e-9), pytest.approx(-73.9633981, abs=1e-9), pytest.approx(55.0))


SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"


def test_wkt(spark):
    parse = lambda t: value(spark, geometry.parse_wkt(F.lit(t)))
    assert [len(r) for r in parse(SQUARE)] == [5, 5]
    assert [tuple(p) for p in parse("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")[0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert parse("POINT (1 2)") is None and parse("POLYGON ((0 0, x 1, 1 1, 0 0))") is None and parse("") is None


@pytest.mark.parametrize(("x", "y", "inside", "near"), [(2.0, 2.0, True, True), (5.0, 5.0, False, True), (12.0, 5.0, False, True), (15.5, 5.0, False, False), (5.0, -5.0, False, True)])
def test_containment(spark, x, y, inside, near):
    rings = geometry.parse_wkt(F.lit(SQUARE))
    assert value(spark, geometry.contains(rings, F.lit(x), F.lit(y))) is inside and value(spark, geometry.within(rings, F.lit(x), F.lit(y), 5.0)) is near


@pytest.mark.parametrize(("box", "meets"), [((2, 2, 3, 3), True), ((4.5, 4.5, 5.5, 5.5), False), ((10, 10, 20, 20), True), ((11, 11, 12, 12), False), ((-5, -5, 50, 50), True)])
def test_boxes(spark, box, meets):
    assert value(spark, geometry.meets_box(geometry.parse_wkt(F.lit(SQUARE)), *(F.lit(float(b)) for b in box))) is meets


def test_rasterised_ring(spark):
    cells = raster.rasterize(spark.range(1).select(F.lit(1).alias("k"), geometry.parse_wkt(F.lit(SQUARE)).alias("rings")), "k").collect()
    assert len(cells) == 100 - 4


def test_heights(spark):
    points = spark.createDataFrame([(0.5, 0.5, 3.0, 2), (0.9, 0.1, 5.0, 4), (0.2, 0.2, 9.0, 7), (1.5, 0.5, -2.0, 2), (2.5, 0.5, 2500.0, 2)], "x double, y double, z double, class int")
    assert {(r.e, r.n): (r.height, r.points, r.veg) for r in raster.height_grid(points).collect()} == {(0, 0): (5.0, 2, 5.0), (1, 0): (0.0, 1, 0.0)}


def test_upper_median(spark):
    cells = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 1), (2, 0, 3, 1), (0, 1, 4, 1), (1, 1, 0, 0), (9, 9, 0, 0)], "e int, n int, h_in int, points int")
    filled = {(r.e, r.n): r.h_in for r in raster.fill_gaps(cells).collect()}
    assert filled[(1, 1)] == 3 and filled[(9, 9)] == 0 and len(filled) == 6


@pytest.mark.parametrize(("veg", "grows"), [(2, True), (1, False)])
def test_green_corner(spark, veg, grows):
    cells = spark.createDataFrame([(0, 0, 0)] + [(e, n, 1 if i < veg else 2) for i, (e, n) in enumerate([(1, 0), (0, 1), (1, 1)])], "e int, n int, class int")
    assert {(r.e, r.n): r["class"] for r in raster.fill_vegetation(cells).collect()}[(0, 0)] == int(grows)


@pytest.mark.parametrize(("odd", "rest", "result"), [(500, 100, 100), (1500, 1440, 1500)])
def test_outliers(spark, odd, rest, result):
    cells = spark.createDataFrame([("b", e, n, odd if (e, n) == (1, 1) else rest) for e in range(3) for n in range(3)], "bin string, e int, n int, h_in int")
    assert {(r.e, r.n): r.h_in for r in raster.replace_outliers(cells).collect()}[(1, 1)] == result


def test_class_order(spark):
    row = spark.createDataFrame([(1, 1, 10.0, 9.0, False, False, False, False)], "e int, n int, height double, veg double, building boolean, land boolean, hydro boolean, near boolean")
    assert [raster.classify(row, first).first()["class"] for first in (True, False)] == [raster.WATER, raster.VEGETATION]


def flat_roof(spark, high=None):
    cells = [("b", e, n, 360 if high and e >= high else 120, True, 0, 0) for e in range(20) for n in range(20)]
    roof = spark.createDataFrame(cells, "bin string, e int, n int, h_in int, mask boolean, sw_e int, sw_n int")
    outline = spark.range(1).select(F.lit("b").alias("bin"), geometry.parse_wkt(F.lit("POLYGON ((0 0, 20 0, 20 20, 0 20, 0 0))")).alias("rings"))
    return outline, roof


def test_flat_roof_samples(spark):
    outline, roof = flat_roof(spark)
    assert rooftop.grid_samples(roof, 10).count() == 4 and rooftop.perimeter_samples(outline, roof, 10.0).count() == 8
    points = rooftop.rooftop_samples(outline, roof, 10.0, 6.0).collect()
    assert len(points) == 12 and {p.z for p in points} == {10.0} and {p.measure_z for p in points} == {16.0}


def test_cliffs(spark):
    _, roof = flat_roof(spark, high=10)
    cliffs = rooftop.cliff_samples(rooftop.grid_samples(roof, 10), 10).collect()
    assert len(cliffs) == 10 and sorted({c.z_in for c in cliffs}) == [180, 240, 300, 360, 420]


def test_only_the_top_is_raised(spark):
    points = spark.createDataFrame([("b", 0.0, 0.0, 5.0, 1), ("b", 0.0, 0.0, 9.0, 2), ("b", 0.0, 0.0, 9.0, 3), ("b", 1.0, 0.0, 1.0, 4)], "bin string, x double, y double, z double, place int")
    assert {r.place: r.measure_z for r in rooftop.mast_points(points, 2.0).collect()} == {1: 5.0, 2: 11.0, 3: 9.0, 4: 3.0}


def test_obstructions_from_a_query(spark):
    rows = spark.createDataFrame(
        [(SQUARE, None, 10.0, "active_permits", "{}"), (SQUARE, 2.0, 10.0, "active_permits", '{"a":1}'), ("POLYGON ((90 90, 91 90, 91 91, 90 90))", None, 1.0, "active_permits", "{}"), (SQUARE, 1.0, None, "active_permits", "{}"), (SQUARE, 1.0, 1.0, "castle", "{}"), ("MULTI" + SQUARE, 1.0, 1.0, "active_permits", "{}")],
        "output_geometry string, ground_elevation double, height_roof double, type string, props string",
    )
    ground = spark.createDataFrame([(2, 2, 36), (5, 5, 600)], "e int, n int, h_in int")
    assert sorted(r.h_in for r in terrain.obstructions_from(rows, ground).collect()) == [144, 156]


def test_city_tiles(spark):
    outline = spark.range(1).select(geometry.parse_wkt(F.lit("POLYGON ((999900 149900, 1001100 149900, 1001100 150600, 999900 150600, 999900 149900))")).alias("rings"))
    assert {(r.ke, r.kn) for r in terrain.city_tiles(outline).collect()} == {(2000, 300), (2001, 300)}


def test_tiles_near_a_building(spark):
    outline = spark.range(1).select(geometry.parse_wkt(F.lit("POLYGON ((1000100 240100, 1000110 240100, 1000110 240110, 1000100 240110, 1000100 240100))")).alias("rings"))
    assert {(r.ke, r.kn) for r in terrain.tiles_near(outline, 250.0).collect()} == {(2000, 480), (1999, 480), (2000, 479), (1999, 479)}
    assert {(r.ke, r.kn) for r in terrain.tiles_near(outline, 120.0).collect()} == {(2000, 480), (1999, 480), (2000, 479)}


def test_footprint_cells_are_flat(spark):
    outline, roof = flat_roof(spark)
    ring = outline.select("bin", geometry.parse_wkt(F.lit("POLYGON ((4.5 4.5, 9.5 4.5, 9.5 9.5, 4.5 9.5, 4.5 4.5))")).alias("rings"))
    cells = terrain.without_footprint(roof.select("bin", "e", "n", "h_in"), ring)
    assert cells.where("h_in = 0").count() == 25 and cells.count() == 400


def test_csv_tables(spark, tmp_path):
    (tmp_path / "f.csv").write_text('BIN,Base BBL,the_geom,Height Roof,Ground Elevation,Construction Year,Last Edited Date\n1000001,1,"POLYGON ((0 0, 1 0, 1 1, 0 0))","1,234.5",,2021,09/02/2025\n2,,,,x,,\n')
    rows = tables.building_footprints(tables.read_csv(spark, str(tmp_path / "f.csv"))).collect()
    assert (rows[0].height_roof, rows[0].ground_elevation, rows[0].construction_year, rows[0].last_edited_date) == (1234.5, 0.0, 2021, datetime.date(2025, 9, 2))
    assert (rows[1].bin, rows[1].base_bbl, rows[1].height_roof, rows[1].construction_year) == ("2", None, 0.0, 0)
    (tmp_path / "t.csv").write_text("BBL,Boro,Block,Lot,the_geom\n1,1,2,3,g\n2,x,2,3,g\n3,300,1,1,g\n")
    assert [(r.bbl, r.borough_name) for r in tables.tax_lots(tables.read_csv(spark, str(tmp_path / "t.csv"))).collect()] == [("1", "MANHATTAN")]
    (tmp_path / "c.csv").write_text("Condo Billing BBL,Condo Base BBL,Condo Base Boro\n1,2,x\n")
    assert tables.condo_units(tables.read_csv(spark, str(tmp_path / "c.csv"))).first().condo_base_boro == 0
    (tmp_path / "j.csv").write_text("BIN,BBL,Borough,Block,Lot,House,Street Name,Job,Job Type,Pre Filing Date,Approved,Proposed Height,Existing Height\n1,short,BRONX,12,3,4,Main,9,NB,01/02/2024,,$30,\n")
    job = tables.dob_job_applications(tables.read_csv(spark, str(tmp_path / "j.csv"))).first()
    assert (job.bbl, job.job_type, job.proposed_height, job.pre_filing_date) == ("2000120003", "nb", 30.0, datetime.date(2024, 1, 2))


def test_user_sql_needs_its_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("bin\n1\n")
    for name in tables.TABLES:
        tables.ingest(spark, str(tmp_path / "x.csv"), name, str(tmp_path / "db"))
    with pytest.raises(ValueError, match="props"):
        tables.run_sql(spark, "SELECT bin, the_geom AS output_geometry, ground_elevation, height_roof, 'x' AS type FROM building_footprints", str(tmp_path / "db"))
    assert tables.run_sql(spark, "SELECT the_geom AS output_geometry, ground_elevation, height_roof, 'x' AS type, '{}' AS props FROM building_footprints", str(tmp_path / "db")).count() == 1


def test_geojson(spark, tmp_path):
    ring = "[[0,0],[4,0],[4,4],[0,0]]"
    (tmp_path / "a.json").write_text(
        f'{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"name":"A","height":"12.5"}},"geometry":{{"type":"Polygon","coordinates":[{ring}]}}}},'
        f'{{"type":"Feature","properties":{{"name":"B","height":3}},"geometry":{{"type":"GeometryCollection","geometries":[{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}},{{"type":"Point","coordinates":[1,2]}}]}}}}]}}'
    )
    shapes = geo.read_geojson(spark, str(tmp_path / "a.json"))
    rows = geo.named_obstructions(shapes, "active_permits").collect()
    assert sorted(r.height_roof for r in rows) == [3.0, 3.0, 12.5] and rows[0].output_geometry.startswith("POLYGON ((0")


@pytest.mark.parametrize(
    ("a", "b", "hertz", "full", "inner"),
    [
        ((1009748.3478422969, 253099.53772897943, 251.25), (1000565.7271487191, 241854.0, 257.6095239708276), 24e9, (11246, 278120), (11246, 166896)),
        ((1013771.106, 246714.567, 150.083), (1009758.4997793691, 253096.57297435577, 251.91700744628906), 60e9, (6382, 65830), (6382, 39486)),
        ((1009948.5, 237111.5, 233.667), (998001.8977003782, 236324.25420103534, 291.61352244298905), 5e9, (789, 456380), (788, 273811)),
    ],
)
def test_zones_of_long_links(spark, a, b, hertz, full, inner):
    """Rows and cells of links of one to three miles, as counted from the ellipsoid's matrix form."""
    link = spark.createDataFrame([(1, *a, *b, hertz)], "link_id int, ae double, an double, az double, be double, bn double, bz double, hertz double")
    for alpha, (rows, cells) in ((1.0, full), (0.6, inner)):
        ends = zone.link_shapes(link, alpha).select((F.floor(F.col("mn") + F.col("reach")) - F.ceil(F.col("mn") - F.col("reach")) + 1).alias("rows")).first()
        made = zone.zone_rows(link, alpha)  # without the rows at the tips that pass no cell
        assert ends.rows == rows and made.agg(F.sum(F.col("e_hi") - F.col("e_lo") + 1)).first()[0] == cells
        assert zone.zone_cells(link, alpha).count() == cells


def test_index_and_footprints_are_read(spark, tmp_path):
    index = spark.createDataFrame([("active_permits", "240_00", ["a", "b"]), ("unheard_of", "240_00", ["c"])], "obstruction_type string, tile_id string, ids array<string>")
    sinks.write_index(index, str(tmp_path / "index"))
    held = geo.read_index(spark, str(tmp_path / "index"))
    assert [tuple(r) for r in held.select("obstruction_type", "tile_id", "ids").collect()] == [("active_permits", "240_00", ["a", "b"])]
    meta = spark.createDataFrame([("active_permits", "a", 3, 4), ("active_permits", "x", 9, 9)], "obstruction_type string, obstruction_id string, w int, h int")
    assert terrain.obstruction_bytes(spark.createDataFrame([("240_00",)], "tile_id string"), held, meta).first()[0] == 24 + 4096
    feature = json.loads(geo.footprint_geojson(_shapes(spark, {"1": [(1000000, 240000), (1000100, 240000), (1000000, 240100), (1000000, 240000)]})).first().feature)
    lon, lat = feature["geometry"]["coordinates"][0][0]
    assert -74.1 < lon < -73.9 and 40.8 < lat < 40.9 and feature["properties"] == {"bin": "1"}
    point = F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("enz", (5, 7, 9))))
    assert [value(spark, tiles.valid_gps(F.lit(lat), F.lit(lon))) for lat, lon in ((40.7, -74.0), (40.2, -72.0), (41.2, -74.0), (40.7, -71.9))] == [True, True, False, False]
    base = F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("enz", (1, 2, 10))))
    assert tuple(value(spark, tiles.relative(point, base))) == (4.0, 5.0, -1.0)


def test_deep_geometry_collections(spark, tmp_path):
    shape = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    for name, levels in (("a", 5), ("b", 8)):
        text = shape
        for _ in range(levels):
            text = f'{{"type":"GeometryCollection","geometries":[{shape},{text}]}}'
        (tmp_path / f"{name}.json").write_text(text)
        assert geo.read_geojson(spark, str(tmp_path / f"{name}.json")).count() == levels + 1
    (tmp_path / "c.json").write_text('{"type":"GeometryCollection","geometries":[' + text + "]}")
    with pytest.raises(Exception, match="nested too deeply"):
        geo.read_geojson(spark, str(tmp_path / "c.json")).collect()


def test_las_points(spark, tmp_path):
    header = bytearray(227)
    header[:4], header[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<HIIBHI", header, 94, 227, 227, 0, 0, 20, 2)
    struct.pack_into("<6d", header, 131, 0.01, 0.01, 0.01, 1000.0, 2000.0, 0.0)
    points = b"".join(struct.pack("<iiiHBBbBH", x, y, z, 0, 0, c, 0, 0, 0) for x, y, z, c in ((100, 200, 300, 5), (-100, 0, 50, 0x47)))
    (tmp_path / "p.las").write_bytes(bytes(header) + points)
    assert [(r.x, r.y, r.z, r["class"]) for r in las.read_las(spark, str(tmp_path)).collect()] == [(1001.0, 2002.0, 3.0, 5), (999.0, 2000.0, 0.5, 7)]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(1000000, 240000, 5), (1002500, 240000, 7)], "e int, n int, h_in int")
    sinks.write_cells(cells, str(tmp_path / "c"))
    assert {r.las for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {240, 2240}
    assert sinks.mesh_faces(cells).where("kind = 'wall'").count() == 8
    assert list(value(spark, sinks.colour(F.lit(0.5)))) == [232, 61, 14]


@pytest.mark.parametrize("late", [0, 600])
def test_streamed_tiles_equal_the_batch(spark, tmp_path, late):
    rows = spark.createDataFrame([(r, c, float((r // 40 * 7 + c // 100) % 5)) for r in range(0, 1200, 40) for c in range(0, 1000, 100)], "row long, col long, feet double")
    order = [0, 200, 400, 600, 800, 1000] if not late else [200, 0, 600, 400, 1000, 800]
    for first in order:  # files are read in the order of their times
        rows.where(F.col("row").between(first, first + 199)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    refresh.end_strips(spark, str(tmp_path / "in"), 1200, late)
    out = refresh.stream_tiles(refresh.read_strips(spark, str(tmp_path / "in"), 1), late=late)
    done = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    batch = raster.retile_elevation(rows).collect()
    streamed = [(r.ke, r.kn, c.e, c.n, c.h_in) for r in spark.read.parquet(str(tmp_path / "out")).collect() for c in r.cells]
    assert sorted(streamed) == sorted((r.ke, r.kn, r.e, r.n, r.h_in) for r in batch) and streamed


def test_refresh_keeps_the_newest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(('{"k":1,"at":1,"v":"a"}\n{"k":2,"at":1,"v":"b"}', '{"k":1,"at":2,"v":"c"}', '{"k":3,"at":1,"v":"d"}')):
        (tmp_path / "in" / f"{i}.json").write_text(text)
        refresh.refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "k int, at int, v string", "k", "at")
    assert {(r.k, r.v) for r in refresh.current(spark, str(tmp_path / "out")).collect()} == {(1, "c"), (2, "b"), (3, "d")}
    (tmp_path / "out" / "version=9").mkdir()  # a batch that was cut off
    assert refresh.current(spark, str(tmp_path / "out")).count() == 3


def test_nearest_status_ends_without_places(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 700, 3), ("b", 1, 1)], "bin string, e int, n int")
    samples = spark.createDataFrame([("a", None, 1.0, 1, 7), ("a", 5.5, 0.5, 2, 8), ("a", 5.5, 0.5, 1, 9), ("b", None, None, 1, 7)], "bin string, x double, y double, sample_id int, status int")
    assert sorted(map(tuple, rooftop.nearest_status(cells, samples, 4).collect())) == [("a", 0, 0, 9), ("a", 700, 3, 9)]
    with pytest.raises(ValueError):
        rooftop.nearest_status(cells, samples, 0)


def _mask(polygon, x, y):
    """Even-odd containment and distance to the edges."""
    inside, far = False, math.inf
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0.0
        far = min(far, math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
    return inside, far


def _shapes(spark, polygons):
    ring = lambda points: [[{"x": float(x), "y": float(y)} for x, y in points]]
    return spark.createDataFrame([(name, ring(points)) for name, points in polygons.items()], "bin string, rings array<array<struct<x:double,y:double>>>")


def test_heightmap_of_a_slanted_roof(spark):
    roof = [(10.2, 20.3), (19.7, 22.1), (17.4, 31.6), (12.1, 29.9), (10.2, 20.3)]
    cells = spark.createDataFrame([(e, n, 100 + e + n) for e in range(8, 25) for n in range(18, 30)], "e int, n int, h_in int")
    got = {(r.e, r.n): (r.mask, r.h_in) for r in rooftop.heightmap(_shapes(spark, {"x": roof}), cells, limit=1e9).collect()}
    expected = {}
    for e in range(10, 20):
        for n in range(20, 32):
            inside, far = _mask(roof, e, n)
            mask = inside or far < 0.5
            expected[e, n] = (mask, 100 + e + n if mask and n < 30 else 0)
    assert got == expected


def test_heightmap_replaces_outliers(spark):
    roof = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    cells = spark.createDataFrame([(e, n, 1000 if (e, n) == (2, 2) else 120) for e in range(5) for n in range(5)], "e int, n int, h_in int")
    assert {r.h_in for r in rooftop.heightmap(_shapes(spark, {"x": roof}), cells).collect()} == {120}


def test_classes_from_polygons(spark):
    shapes = {"building": [(3, 3), (9, 4), (7, 11), (3, 3)], "structure": [(20, 3), (26, 5), (22, 9), (20, 3)], "hydro": [(3, 20), (9, 21), (6, 27), (3, 20)], "land": [(-1, -1), (31, -1), (31, 19), (-1, 17), (-1, -1)]}
    grid = [(e, n, float((e * 7 + n * 3) % 11), float((e * 5 + n) % 13)) for e in range(30) for n in range(30)]
    table = spark.createDataFrame(grid, "e int, n int, height double, veg double")
    one = {k: _shapes(spark, {k: v}) for k, v in shapes.items()}
    got = {(r.e, r.n): r["class"] for r in raster.class_grid(table, one["building"], one["structure"], one["hydro"], one["land"]).collect()}
    first = {}
    for e, n, height, veg in grid:
        at = {k: _mask(v, e + 0.5, n + 0.5) for k, v in shapes.items()}
        near = any(at[k][0] or at[k][1] <= 5 for k in ("building", "structure", "hydro"))
        first[e, n] = 2 if at["building"][0] else 3 if not at["land"][0] and not at["hydro"][0] else 1 if veg > 0 and veg >= height - 5 and not near else 0
    expected = dict(first)
    for (e, n), kind in first.items():
        if kind == 0:
            around = [first[e + i, n + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (e + i, n + j) in first]
            if sum(x == 1 for x in around) > len(around) // 2:
                expected[e, n] = 1
    assert got == expected and set(got.values()) == {0, 1, 2, 3}


def test_tiles_are_split_and_read_dense(spark):
    cells = spark.createDataFrame([(1000000, 240000, 5, 0), (1000499, 240499, 0, 2), (1000500, 240000, 0, 3), (1001000, 240001, 65535, 3)], "e int, n int, h_in int, class int")
    held = raster.split_tiles(cells)
    assert sorted((r.ke, r.kn) for r in held.select("ke", "kn").collect()) == [(2000, 480), (2002, 480)]
    wanted = spark.createDataFrame([(2000, 480), (2001, 480), (2002, 480)], "ke int, kn int")
    dense = raster.tile_cells(wanted, held)
    assert dense.count() == 3 * 250_000
    assert sorted(map(tuple, dense.where("h_in > 0 OR class <> 3").select("e", "n", "h_in", "class").collect())) == [(1000000, 240000, 5, 0), (1000499, 240499, 0, 2), (1001000, 240001, 65535, 3)]


def test_lifetimes(spark):
    rows = spark.sql("SELECT * FROM VALUES ('lite', TIMESTAMP '2024-01-01 00:00:00'), ('full', TIMESTAMP '2024-01-01 00:00:00') AS t(kind, stored_at)")
    assert [r.kind for r in refresh.alive(rows, "2024-01-01 00:01:00").collect()] == ["lite"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.date() if isinstance(v, datetime.datetime) else float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_same_key_latest_and_tie(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "w"), ("a", None, "z")], "k string, d int, t string")
    assert filings.one_per_key(rows, ["k"], "d", "t").first().t == "w" and filings.one_per_key(rows, ["k"], "d", "t", latest=False).first().t == "z"
