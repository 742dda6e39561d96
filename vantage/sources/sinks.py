"""Writing tables, rasters, the index, the tile list and simple drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions import tiles


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells (e, n, ..) by 2500-foot tile."""
    las = tiles.las_name(tiles.component(F.col("e")), tiles.component(F.col("n")))
    cells.withColumn("las", las).repartition("las").sortWithinPartitions("las", "n", "e").write.mode("overwrite").partitionBy("las").parquet(path)


def write_obstructions(obstructions: DataFrame, path: str) -> None:
    obstructions.write.mode("overwrite").partitionBy("type").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("obstruction_type").json(path)


def write_city_tiles(city: DataFrame, path: str) -> None:
    """Tile ids in the order of their packed numbers."""
    city.select("tile_id", tiles.packed(F.col("ke"), F.col("kn")).alias("packed")).orderBy("packed").write.mode("overwrite").json(path)


def footprint_texts(footprints: DataFrame) -> DataFrame:
    """bin and WKT of footprints that have both; the last edited of a building stays."""
    some = footprints.where(F.col("bin").isNotNull() & (F.col("bin") != "") & F.col("the_geom").isNotNull() & (F.col("the_geom") != ""))
    return some.groupBy("bin").agg(F.max_by("the_geom", F.struct("last_edited_date", "the_geom")).alias("wkt"))


def colour(value: Column) -> Column:
    """Red, green, blue of a share 0..1, straight between five stops, cut to whole numbers."""
    # Stops and their colours.
    stops = [(0.0, (255, 215, 0)), (0.4, (255, 105, 0)), (0.6, (210, 18, 28)), (0.75, (138, 0, 16)), (1.0, (214, 2, 52))]
    held = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    out = F
    for (a, low), (b, high) in zip(stops, stops[1:]):
        t = (held - a) / (b - a)
        out = out.when(held <= b, F.array(*((F.lit(x) + t * (y - x)).cast("int") for x, y in zip(low, high))))
    return out


def mesh_faces(cells: DataFrame) -> DataFrame:
    """Faces of a heightmap (e, n, h_in): each cell's top, and a wall to every lower neighbour (or to 0 at the rim).

    kind, e, n, side (e, w, n, s), low, high.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(i).alias("i"), F.lit(j).alias("j")) for s, i, j in (("e", 1, 0), ("w", -1, 0), ("n", 0, 1), ("s", 0, -1)))))
    walls = cells.select("e", "n", "h_in", sides.alias("s")).select("e", "n", "h_in", "s.side", (F.col("e") + F.col("s.i")).alias("oe"), (F.col("n") + F.col("s.j")).alias("on"))
    other = cells.select(F.col("e").alias("oe"), F.col("n").alias("on"), F.col("h_in").alias("oh"))
    walls = walls.join(other, ["oe", "on"], "left").select(F.lit("wall").alias("kind"), "e", "n", "side", F.coalesce("oh", F.lit(0)).alias("low"), F.col("h_in").alias("high")).where("low < high")
    tops = cells.select(F.lit("top").alias("kind"), "e", "n", F.lit(None).cast("string").alias("side"), F.col("h_in").alias("low"), F.col("h_in").alias("high"))
    return tops.unionByName(walls)
