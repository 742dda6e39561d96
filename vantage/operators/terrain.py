"""Obstructions and terrain: tiles of boxes, index, splitting, merging by the highest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions import geometry, tiles
from vantage.functions.normalize import inches
from vantage.operators.raster import rasterize

#: Bytes of a raster (two a cell) above which it is cut into one for each tile.
RASTER_BYTES = 1_048_576
# The types of obstructions.
TYPES = ["active_permits", "approved_job_applications", "non_surveyed_bridge", "new_construction_co", "new_construction_footprints", "recent_job_applications"]


def box_tiles(boxes: DataFrame, *keep: str) -> DataFrame:
    """ke, kn of the tiles that a box of whole cells (e, n, w, h) has cells in, with the columns ``keep``."""
    over = lambda start, size: F.explode(F.sequence(tiles.tile_key(F.col(start)), tiles.tile_key(F.col(start) + F.col(size) - 1)))
    return boxes.select("*", over("e", "w").alias("ke")).select("*", over("n", "h").alias("kn")).select(*keep, "ke", "kn")


#: Powers of two, in feet, of the finest and the widest grid that boxes meet in.
FINEST, WIDEST = 4, 40


def _over_grid(boxes: DataFrame, side: str) -> DataFrame:
    """Rows of boxes for each cell (cx, cy) of their level's grid that they share a point with."""
    unit = F.pow(F.lit(2.0), F.col("level"))
    for cell, low, size in (("cx", "e", "w"), ("cy", "n", "h")):
        start = F.col(f"_{side}{low}")
        boxes = boxes.withColumn(cell, F.explode(F.sequence(F.floor(start / unit), F.floor((start + F.col(f"_{side}{size}")) / unit))))
    return boxes.drop("own")


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of boxes (e, n, w, h) that overlap, each once: joined by cells of a grid as wide as the larger box, then compared.

    A box is in four cells of its own level's grid about. It goes to the wider grids as well, but only
    to those of levels that boxes of the other side have.
    """
    sides = {}
    for side, df, key in (("a", left, left_id), ("b", right, right_id)):
        own = F.least(F.ceil(F.log2(F.greatest("w", "h", F.lit(2**FINEST)))), F.lit(WIDEST)).cast("int")
        sides[side] = df.select(F.col(key).alias(f"_{side}"), *(F.col(c).alias(f"_{side}{c}") for c in "enwh"), own.alias("own"))
    corners = [(F.col(f"_{s}e"), F.col(f"_{s}n"), F.col(f"_{s}e") + F.col(f"_{s}w"), F.col(f"_{s}n") + F.col(f"_{s}h")) for s in "ab"]
    unit = F.pow(F.lit(2.0), F.col("level"))
    first = (F.col("cx") == F.floor(F.greatest("_ae", "_be") / unit)) & (F.col("cy") == F.floor(F.greatest("_an", "_bn") / unit))  # of the shared cells
    found = []
    for wide, small, more in (("a", "b", 0), ("b", "a", 1)):  # pairs of one level meet in the first part alone
        levels = F.broadcast(sides[wide].select(F.col("own").alias("level")).distinct())  # 37 at most
        upward = F.explode(F.when(F.col("own") + more <= WIDEST, F.sequence(F.col("own") + more, F.lit(WIDEST))))
        spread = _over_grid(sides[small].withColumn("level", upward).join(levels, "level", "left_semi"), small)
        met = _over_grid(sides[wide].withColumn("level", F.col("own")), wide).hint("merge").join(spread, ["level", "cx", "cy"])
        found.append(met.where(geometry.boxes_overlap(*corners) & first).select(F.col("_a").alias(left_id), F.col("_b").alias(right_id)))
    return found[0].unionByName(found[1])


def polygon_tiles(polygons: DataFrame, *keep: str) -> DataFrame:
    """ke, kn of tiles that share a point with a polygon (column rings), edges included."""
    box = geometry.bounds(F.col("rings"))
    tried = polygons.select(*keep, "rings", box.alias("b"))
    span = lambda low, high: F.sequence(tiles.tile_key(F.col(low) - 1), tiles.tile_key(F.col(high) + 1))
    pairs = tried.select(*keep, "rings", F.explode(span("b.west", "b.east")).alias("ke"), "b").select(*keep, "rings", "ke", F.explode(span("b.south", "b.north")).alias("kn"))
    west, south = (F.col(k).cast("double") * tiles.SIDE for k in ("ke", "kn"))
    return pairs.where(geometry.meets_box(F.col("rings"), west, south, west + tiles.SIDE, south + tiles.SIDE)).select(*keep, "ke", "kn")


def tiles_near(polygons: DataFrame, feet: float, *keep: str) -> DataFrame:
    """ke, kn of tiles at most ``feet`` from a polygon (column rings)."""
    box = geometry.bounds(F.col("rings"))
    span = lambda low, high: F.sequence(tiles.tile_key(F.col(low) - feet - 1), tiles.tile_key(F.col(high) + feet + 1))
    tried = polygons.select(*keep, "rings", box.alias("b")).select(*keep, "rings", "b", F.explode(span("b.west", "b.east")).alias("ke"))
    pairs = tried.select(*keep, "rings", "ke", F.explode(span("b.south", "b.north")).alias("kn"))
    west, south = (F.col(k).cast("double") * tiles.SIDE for k in ("ke", "kn"))
    east, north = west + tiles.SIDE, south + tiles.SIDE
    corners = F.least(*(geometry.distance_to_edge(F.col("rings"), x, y) for x in (west, east) for y in (south, north)))

    def to_box(p: Column) -> Column:
        dx, dy = F.greatest(west - p["x"], p["x"] - east, F.lit(0.0)), F.greatest(south - p["y"], p["y"] - north, F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)

    points = F.array_min(F.transform(F.flatten(F.col("rings")), to_box))
    return pairs.where(geometry.meets_box(F.col("rings"), west, south, east, north) | (F.least(corners, points) <= feet)).select(*keep, "ke", "kn")


def _turns(polygons: DataFrame) -> DataFrame:
    """bin, _south and _turns of polygons (bin, rings): the places where edges cross each whole northing from _south on."""
    box = geometry.bounds(F.col("rings"))
    sided = polygons.select("bin", geometry.edges(F.col("rings")).alias("sides"), F.ceil(box["south"]).alias("_south"), F.ceil(box["north"]).alias("_north"))
    rows = F.sequence("_south", F.greatest("_south", "_north"))
    return sided.select("bin", "_south", F.transform(rows, lambda n: geometry.crossings(F.col("sides"), n.cast("double"))).alias("_turns"))


def without_footprint(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cells (bin, e, n, h_in) with height 0 where their south-west corner is in the building's own polygon (bin, rings)."""
    own = cells.join(_turns(polygons).hint("merge"), "bin", "left")
    row = F.try_element_at("_turns", (F.col("n") - F.col("_south") + 1).cast("int"))
    inside = F.when(F.col("n") >= F.col("_south"), F.size(F.filter(row, lambda x: F.col("e").cast("double") < x)) % 2 == 1)
    return own.withColumn("h_in", F.when(inside, 0).otherwise(F.col("h_in"))).drop("_south", "_turns")


def obstruction_index(meta: DataFrame) -> DataFrame:
    """obstruction_type, tile_id and the sorted ids there of obstruction_id, obstruction_type, tile_ids."""
    pairs = meta.select("obstruction_type", "obstruction_id", F.explode("tile_ids").alias("tile_id")).distinct()
    return pairs.groupBy("obstruction_type", "tile_id").agg(F.sort_array(F.collect_list("obstruction_id")).alias("ids"))


def obstructions_near(wanted: DataFrame, index: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct type and id of what the index has in the wanted tiles; ``types`` None: all."""
    chosen = index if types is None else index.where(F.col("obstruction_type").isin(*types) if types else F.lit(False))
    found = chosen.join(wanted.select("tile_id").distinct(), "tile_id", "left_semi")
    return found.select("obstruction_type", F.explode("ids").alias("obstruction_id")).distinct()


def stored_bytes(w: Column, h: Column) -> Column:
    return w.cast("long") * h * 2


def split_large(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of obstructions with chunk_id and group_id: large rasters have a chunk for each tile with a height.

    ``meta``: obstruction_id, w, h; ``cells``: obstruction_id, e, n, h_in.
    """
    large = stored_bytes(F.col("w"), F.col("h")) > RASTER_BYTES
    keyed = cells.join(meta.select("obstruction_id", large.alias("large")).hint("merge"), "obstruction_id")
    ke, kn = (F.when(F.col("large"), tiles.tile_key(F.col(c))) for c in "en")
    chunk = Window.partitionBy("obstruction_id", "_ke", "_kn")  # where the join has dealt the cells to
    held = keyed.withColumns({"_ke": ke, "_kn": kn}).withColumn("_top", F.max("h_in").over(chunk)).where("_top > 0")
    name = F.when(F.col("large"), F.concat_ws("/", "obstruction_id", tiles.tile_id(F.col("_ke"), F.col("_kn")))).otherwise(F.col("obstruction_id"))
    return held.select(name.alias("chunk_id"), F.when(F.col("large"), F.col("obstruction_id")).alias("group_id"), "e", "n", "h_in")


def highest(*layers: DataFrame) -> DataFrame:
    """e, n and the highest h_in of all layers there."""
    rows = reduce(lambda a, b: a.unionByName(b), (x.select("e", "n", "h_in") for x in layers))
    return rows.groupBy("e", "n").agg(F.max("h_in").alias("h_in"))


def ground_under(polygons: DataFrame, elevation: DataFrame, key: str) -> DataFrame:
    """The highest elevation (feet) among cells whose centre is in a polygon; none: no row."""
    return rasterize(polygons, key).hint("merge").join(elevation, ["e", "n"]).groupBy(key).agg((F.max("h_in") / 12).alias("ground"))


def obstructions_from(rows: DataFrame, elevation: DataFrame) -> DataFrame:
    """Rows of an obstruction query to obstruction_id, type, props, h_in, rings and bounds.

    Rows without a geometry, height, type or props are dropped, and those of unknown types,
    other shapes than polygons, or without a ground height. Ids are hashes of the row.
    """
    usable = rows.where(F.col("output_geometry").isNotNull() & F.col("height_roof").isNotNull() & F.col("type").isin(*TYPES) & F.col("props").isNotNull())
    parsed = usable.where(~F.upper(F.trim("output_geometry")).startswith("MULTI")).withColumn("rings", geometry.parse_wkt(F.col("output_geometry"))).where(F.col("rings").isNotNull())
    named = parsed.withColumn("obstruction_id", F.substring(F.sha2(F.concat_ws("|", "type", "output_geometry", "props"), 256), 1, 32))
    grounds = ground_under(named.where("ground_elevation IS NULL"), elevation, "obstruction_id").dropDuplicates(["obstruction_id"])
    tall = inches(F.coalesce("ground_elevation", "ground") + F.col("height_roof"))
    return named.join(grounds, "obstruction_id", "left").withColumn("h_in", tall).where("h_in IS NOT NULL").select(
        "obstruction_id", "type", "props", "h_in", "rings", geometry.bounds(F.col("rings")).alias("box")
    )


def city_tiles(outline: DataFrame) -> DataFrame:
    """ke, kn, tile_id of tiles wholly inside an outline (column rings)."""
    box = geometry.bounds(F.col("rings"))
    spans = outline.select("rings", box.alias("b")).select("rings", "b", F.explode(F.sequence(tiles.tile_key(F.col("b.west")), tiles.tile_key(F.col("b.east")))).alias("ke"))
    pairs = spans.select("rings", "ke", F.explode(F.sequence(tiles.tile_key(F.col("b.south")), tiles.tile_key(F.col("b.north")))).alias("kn"))
    west, south = (F.col(k).cast("double") * tiles.SIDE for k in ("ke", "kn"))
    held = pairs.where(geometry.holds_box(F.col("rings"), west, south, west + tiles.SIDE, south + tiles.SIDE))
    return held.select("ke", "kn", tiles.tile_id(F.col("ke"), F.col("kn")).alias("tile_id")).distinct()


def hydro(*layers: DataFrame) -> DataFrame:
    """rings of the hydro structures of all layers (of the street map and the survey), one after the other."""
    return reduce(lambda a, b: a.unionByName(b), (x.select("rings") for x in layers))


def obstruction_bytes(wanted: DataFrame, index: DataFrame, meta: DataFrame, head: int = 4096) -> DataFrame:
    """One row, bytes: of the rasters (two a cell and ``head`` each) of all obstructions in the wanted tiles.

    ``meta``: obstruction_type, obstruction_id, w, h.
    """
    near = obstructions_near(wanted, index).join(meta, ["obstruction_type", "obstruction_id"])
    return near.agg(F.coalesce(F.sum(stored_bytes(F.col("w"), F.col("h")) + head), F.lit(0)).cast("long").alias("bytes"))
