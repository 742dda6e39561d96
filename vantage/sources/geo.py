"""Shapes and metadata from GeoJSON, Esri JSON, WKT tables and obstruction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import geometry, projection
from vantage.operators.terrain import TYPES

_RING = "array<array<double>>"
_GEOMETRY = f"type string, coordinates string, geometries string, rings array<{_RING}>"
#: Levels of geometry collections in collections that are opened; deeper ones are an error.
LEVELS = 8
_FEATURE = f"type string, properties map<string,string>, geometry struct<{_GEOMETRY.replace(' string', ':string').replace(' array', ':array')}>"


def _points(polygon: Column) -> Column:
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def polygons_of(df: DataFrame, kind: str, coordinates: str, *keep: str) -> DataFrame:
    """rings of each Polygon and of each part of a MultiPolygon (coordinates as JSON text); other shapes are dropped."""
    one, many = (F.from_json(F.when(F.col(kind) == t, F.col(coordinates)), s) for t, s in (("Polygon", f"array<{_RING}>"), ("MultiPolygon", f"array<array<{_RING}>>")))
    return df.select(*keep, F.explode(F.coalesce(F.when(one.isNotNull(), F.array(one)), many)).alias("_p")).select(*keep, _points(F.col("_p")).alias("rings"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """properties and rings of every polygon in files of a FeatureCollection, a Feature or a geometry.

    Geometry collections are opened to LEVELS levels; a deeper one fails the query, so no shape is lost.
    """
    collection = f"type string, features array<struct<{_FEATURE.replace('type string, properties map', 'type:string,properties:map').replace(', geometry struct', ',geometry:struct')}>>"
    text = spark.read.option("wholetext", True).text(path)
    whole, single, bare = (F.from_json("value", s) for s in (collection, _FEATURE, _GEOMETRY))
    as_feature = F.struct(whole["type"].alias("type"), F.create_map().cast("map<string,string>").alias("properties"), bare.alias("geometry"))
    rows = text.select(F.explode(F.when(whole["type"] == "FeatureCollection", whole["features"]).when(whole["type"] == "Feature", F.array(single)).otherwise(F.array(as_feature))).alias("f"))
    shapes = rows.select("f.properties", "f.geometry.*")
    level = shapes.select("properties", "type", "coordinates", "geometries")
    found = level.select("properties", "type", "coordinates")
    for _ in range(LEVELS):
        inner = F.explode(F.from_json("geometries", "array<struct<type:string,coordinates:string,geometries:string>>")).alias("g")
        level = level.select("properties", inner).select("properties", "g.*")
        found = found.unionByName(level.select("properties", "type", "coordinates"))
    deeper = level.where("geometries IS NOT NULL").select("properties", F.raise_error(F.lit("geometry collections are nested too deeply")).cast("string").alias("type"), "coordinates")
    return polygons_of(found.unionByName(deeper), "type", "coordinates", "properties")


def named_obstructions(shapes: DataFrame, kind: str) -> DataFrame:
    """GeoJSON polygons with a name and a height (number or numeric text) as rows of an obstruction query."""
    height = F.col("properties")["height"].try_cast("double")
    if shapes.where(F.col("properties")["name"].isNull() | height.isNull()).limit(1).count():
        raise ValueError("every shape needs a name and a height")
    ring = F.transform(F.col("rings"), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return shapes.select(
        geometry.rings_to_wkt(ring).alias("output_geometry"), F.lit(0.0).alias("ground_elevation"), height.alias("height_roof"), F.lit(kind).alias("type"), F.to_json("properties").alias("props")
    )


def esri_features(df: DataFrame, text: str = "value") -> DataFrame:
    """attributes and the_geom (WKT, empty for none) of the features in pages of Esri JSON."""
    page = F.from_json(text, f"features array<struct<attributes:map<string,string>,geometry:struct<rings:array<{_RING}>>>>")
    return df.select(F.explode(page["features"]).alias("f")).select("f.attributes", geometry.rings_to_wkt(F.col("f.geometry.rings")).alias("the_geom"))


def wkt_polygons(df: DataFrame, column: str = "the_geom") -> DataFrame:
    """``df`` with rings; rows without a readable polygon are dropped."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).withColumn("rings", geometry.parse_wkt(F.col(column))).where("rings IS NOT NULL")


def geometry_column(df: DataFrame) -> str:
    """The name of the geometry column in whatever case."""
    for name in df.columns:
        if name.lower() == "the_geom":
            return name
    raise ValueError("no column the_geom")


def read_obstructions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Obstruction records of one type, of the newer or the older shape."""
    schema = "obstruction_id string, id string, obstruction_type string, attributes map<string,string>, tile_ids array<string>, offset_nys struct<easting:double,northing:double>, x_offset double, y_offset double, width int, height int, obstruction_group_id string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(
        F.coalesce("obstruction_id", "id").alias("obstruction_id"), F.coalesce("obstruction_type", F.lit(kind)).alias("obstruction_type"), "attributes", "tile_ids",
        F.coalesce("offset_nys.easting", "x_offset").alias("e"), F.coalesce("offset_nys.northing", "y_offset").alias("n"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("obstruction_group_id").alias("group_id"),
    )


def elevation_or_zero(wanted: DataFrame, city: DataFrame, cells: DataFrame) -> DataFrame:
    """wanted tiles (ke, kn) in the city with their cells; a tile without any has one row of nulls and counts as height 0."""
    return wanted.join(city.select("ke", "kn").distinct(), ["ke", "kn"], "left_semi").join(cells, ["ke", "kn"], "left")


def outside_city(wanted: DataFrame, city: DataFrame) -> DataFrame:
    """Wanted tiles that aren't in the city; any of them fails its link."""
    return wanted.join(city.select("ke", "kn").distinct(), ["ke", "kn"], "left_anti")


def footprint_of(footprints: DataFrame, bin_id: str) -> DataFrame:
    """The one footprint of a building; raises for none or several."""
    rows = footprints.where(F.col("bin") == bin_id)
    found = rows.limit(2).count()
    if found != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} footprint of {bin_id}")
    return rows


def building_of(numbers: DataFrame, nodes: DataFrame, installs: DataFrame, buildings: DataFrame) -> DataFrame:
    """number and bin of the first building with a valid bin of its node, else of its install.

    ``nodes``: number, building_ids; ``installs``: number, building_id; ``buildings``: building_id, bin.
    """
    valid = buildings.where(F.col("bin").rlike(r"^[1-5][0-9]{6}$"))
    through = nodes.select("number", F.posexplode("building_ids").alias("place", "building_id")).join(valid, "building_id").groupBy("number").agg(F.min_by("bin", "place").alias("_node"))
    direct = installs.join(valid, "building_id").groupBy("number").agg(F.min("bin").alias("_install"))
    return numbers.select("number").distinct().join(through, "number", "left").join(direct, "number", "left").select("number", F.coalesce("_node", "_install").alias("bin"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """obstruction_type, tile_id and ids of a written index; unknown types are left out."""
    rows = spark.read.option("basePath", path).schema("obstruction_type string, tile_id string, ids array<string>").json(path)
    return rows.where(F.col("obstruction_type").isin(*TYPES))


def footprint_geojson(footprints: DataFrame) -> DataFrame:
    """bin and a GeoJSON feature of its outline (rings, feet) in degrees."""
    place = lambda p: projection.to_degrees(p["x"], p["y"], F.lit(0.0))
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(place(p)["lon"], place(p)["lat"])))
    shape = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return footprints.select("bin", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("bin").alias("properties"), shape.alias("geometry"))).alias("feature"))
