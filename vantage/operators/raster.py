"""Rasters as rows of cells (e, n, ..): heights from points, tiles, gaps, classes.

A cell is the one-foot square whose south-west corner is (e, n). Neighbourhoods spread the sparse
side (gaps, unclassified cells) to its neighbours and join, instead of nine copies of every cell.
Joins of cells are merges by hint: Spark takes rows that were exploded for as many as they came from,
and would broadcast them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions import geometry, tiles
from vantage.functions.normalize import inches

NONE, VEGETATION, BUILDING, WATER = 0, 1, 2, 3
# Point classes of noise and of vegetation, and the highest point that counts.
NOISE, PLANTS, CEILING = (7, 18), (3, 4, 5), 2000.0
#: Feet of a roof from west to east that one task takes.
STRIP = 256


def height_grid(points: DataFrame) -> DataFrame:
    """x, y, z, class of points to e, n, height (the highest z, 0 at least), points, veg (highest of plants)."""
    return (
        points.where(~F.col("class").isin(*NOISE) & (F.col("z") < CEILING))
        .groupBy(F.floor("x").cast("int").alias("e"), F.floor("y").cast("int").alias("n"))
        .agg(
            F.greatest(F.max("z"), F.lit(0.0)).alias("height"),
            F.count(F.lit(1)).alias("points"),
            F.greatest(F.max(F.when(F.col("class").isin(*PLANTS), F.col("z"))), F.lit(0.0)).alias("veg"),
        )
    )


def within_file(points: DataFrame, side: int = 2500) -> DataFrame:
    """Points (x, y, file) inside the tile of ``side`` feet that their file is named after; a file of another name is an error."""
    corner = tiles.parse_las_name(F.col("file"))
    inside = [F.floor(F.col(axis)).between(low, low + side - 1) for axis, low in (("x", tiles.component_feet(corner["e"])), ("y", tiles.component_feet(corner["n"])))]
    named = F.when(corner.isNull(), F.raise_error(F.concat(F.lit("not named after a tile: "), F.coalesce("file", F.lit("null")))).cast("boolean"))
    return points.where(named.otherwise(inside[0] & inside[1]))


def kept_tiles(cells: DataFrame) -> DataFrame:
    """ke, kn of tiles (500-foot indexes) with a height or a class other than water; absent cells have neither."""
    keys = (tiles.tile_key(F.col("e")).alias("ke"), tiles.tile_key(F.col("n")).alias("kn"))
    return cells.groupBy(*keys).agg(F.bool_or((F.col("h_in") != 0) | (F.col("class") != WATER)).alias("keep")).where("keep").select("ke", "kn")


def retile_elevation(rows: DataFrame, west: int = 910720, north: int = 275160) -> DataFrame:
    """Cells of an image (row 0 in the north, col, feet) to ke, kn, e, n, h_in; tiles of zeros are dropped."""
    cells = rows.select((F.col("col") + west).cast("int").alias("e"), (F.lit(north) - F.col("row") - 1).cast("int").alias("n"), inches(F.col("feet")).alias("h_in"))
    keyed = cells.withColumns({"ke": tiles.tile_key(F.col("e")), "kn": tiles.tile_key(F.col("n"))})
    some = keyed.groupBy("ke", "kn").agg(F.max("h_in").alias("top")).where("top > 0").select("ke", "kn")
    return keyed.join(some, ["ke", "kn"], "left_semi").select("ke", "kn", "e", "n", "h_in")


def around(cells: DataFrame, *keep: str) -> DataFrame:
    """Each cell's eight neighbours: e, n of the neighbour and te, tn of the cell, with ``keep``."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    return cells.select(F.col("e").alias("te"), F.col("n").alias("tn"), *keep, F.explode(steps).alias("s")).select(
        (F.col("te") + F.col("s.i")).alias("e"), (F.col("tn") + F.col("s.j")).alias("n"), "te", "tn", *keep
    )


def fill_gaps(cells: DataFrame) -> DataFrame:
    """e, n, h_in of a grid (e, n, h_in, points): cells without points get the upper median of their positive neighbours, or 0."""
    gaps = cells.where("points = 0")
    near = around(gaps).join(cells.where("h_in > 0").select("e", "n", "h_in").hint("merge"), ["e", "n"])
    found = near.groupBy(F.col("te").alias("e"), F.col("tn").alias("n")).agg(F.array_sort(F.collect_list("h_in")).alias("v"))  # eight at most
    filled = gaps.select("e", "n").join(found.hint("merge"), ["e", "n"], "left").select("e", "n", F.coalesce(F.get("v", F.floor(F.size("v") / 2).cast("int")), F.lit(0)).alias("h_in"))
    return cells.where("points <> 0").select("e", "n", "h_in").unionByName(filled)


def fill_vegetation(cells: DataFrame) -> DataFrame:
    """e, n, class: unclassified cells become plants where more than half (rounded down) of their neighbours in the grid are."""
    open_cells = cells.where(F.col("class") == NONE)
    near = around(open_cells).join(cells.select("e", "n", "class").hint("merge"), ["e", "n"])
    counts = near.groupBy(F.col("te").alias("e"), F.col("tn").alias("n")).agg(F.sum((F.col("class") == VEGETATION).cast("int")).alias("veg"), F.count(F.lit(1)).alias("total"))
    green = counts.where(F.col("veg") > F.floor(F.col("total") / 2)).select("e", "n", F.lit(True).alias("green"))
    joined = cells.select("e", "n", "class").join(green.hint("merge"), ["e", "n"], "left")
    return joined.select("e", "n", F.when(F.col("green"), VEGETATION).otherwise(F.col("class")).cast("int").alias("class"))


def replace_outliers(cells: DataFrame, limit: float = 180.0, *keep: str) -> DataFrame:
    """bin, e, n, h_in of roof cells, with ``keep``: a height further than ``limit`` inches from its neighbours' mean becomes the mean, rounded.

    Where there is a column mask, only cells with it are changed and are neighbours. Each cell is
    spread over its row's three places and added up there, and these sums over three along each
    column: three rows a cell instead of eight, and no join. Cells are dealt out once, by roof and
    strip of STRIP feet (those at its ends to both), before they are spread.
    """
    masked = F.col("mask") if "mask" in keep else F.lit(True)
    strip = lambda step: F.floor((F.col("e") + step) / STRIP)
    dealt = cells.select("bin", "e", "n", "h_in", *keep, F.explode(F.array_distinct(F.array(*map(strip, (-1, 0, 1))))).alias("strip")).repartition("bin", "strip")
    across = dealt.select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("d")).withColumn("at", F.col("e") + F.col("d")).where(F.floor(F.col("at") / STRIP) == F.col("strip"))
    own = [F.max(F.when(F.col("at") == F.col("e"), F.col(c))).alias(c) for c in ("h_in", *keep)]
    rows = across.groupBy("bin", "strip", F.col("at"), "n").agg(F.sum(F.when(masked, F.col("h_in"))).alias("s"), F.count_if(masked).alias("c"), *own).withColumnRenamed("at", "e")
    column = Window.partitionBy("bin", "strip", "e").orderBy("n").rangeBetween(-1, 1)
    nine = rows.withColumns({"s": F.sum("s").over(column), "c": F.sum("c").over(column)}).where("h_in IS NOT NULL")
    mean = (F.col("s") - F.col("h_in")) / F.nullif(F.col("c") - 1, F.lit(0))
    return nine.select("bin", "e", "n", F.when(masked & (F.abs(F.col("h_in") - mean) > limit), F.round(mean).cast("int")).otherwise(F.col("h_in")).alias("h_in"), *keep)


def row_spans(polygons: DataFrame, *keep: str) -> DataFrame:
    """n, first and last of the runs of cells whose centre is inside a polygon (column rings), with ``keep``.

    Row by row: the places where edges cross the row's middle, in order, are where the inside
    begins and ends in turn (even-odd), so no cell is tested on its own. Edges are made once for
    each polygon; rows without a crossing are dropped by an explode, since a filter would be pushed
    below the step before and find the crossings twice.
    """
    sided = polygons.select(*keep, geometry.edges(F.col("rings")).alias("sides"), geometry.bounds(F.col("rings")).alias("b"))
    rows = sided.select(*keep, "sides", F.explode(F.sequence(F.floor("b.south"), F.greatest(F.ceil("b.north") - 1, F.floor("b.south")))).alias("n"))
    turns = rows.select(*keep, "n", F.explode(F.array(geometry.crossings(F.col("sides"), F.col("n") + 0.5))).alias("c")).where(F.size("c") > 1)
    spans = turns.select(*keep, "n", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))).alias("i"))
    return spans.select(*keep, "n", F.ceil(F.get("c", F.col("i")) - 0.5).alias("first"), (F.ceil(F.get("c", F.col("i") + 1) - 0.5) - 1).alias("last"))


def rasterize(polygons: DataFrame, *keep: str) -> DataFrame:
    """e, n of cells whose centre is inside a polygon (column rings), with ``keep``."""
    cells = row_spans(polygons, *keep).select(*keep, "n", F.explode(F.when(F.col("last") >= F.col("first"), F.sequence("first", "last"))).alias("e"))
    return cells.select(*keep, F.col("e").cast("int").alias("e"), F.col("n").cast("int").alias("n"))


def _pieces(polygons: DataFrame, *keep: str) -> DataFrame:
    """Pieces (x1, y1, x2, y2) of at most 64 feet of the edges of polygons (column rings), with ``keep``."""
    c = F.col
    cut = polygons.select(*keep, F.explode(geometry.edges(F.col("rings"))).alias("s")).select(*keep, "s.*")
    parts = F.greatest(F.ceil(F.sqrt((c("x2") - c("x1")) ** 2 + (c("y2") - c("y1")) ** 2) / 64), F.lit(1))
    cut = cut.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), c("parts") - 1)))
    place = lambda a, b, k: c(a) + (c(b) - c(a)) * (k / c("parts"))
    return cut.select(*keep, *(place(f"{x}1", f"{x}2", c("i") + k).alias(f"{x}{k + 1}") for k in (0, 1) for x in "xy"))


def _squared(e: Column, n: Column) -> Column:
    """The square of the distance from a cell's centre to a piece (x1, y1, x2, y2)."""
    c = F.col
    dx, dy, px, py = c("x2") - c("x1"), c("y2") - c("y1"), e + 0.5 - c("x1"), n + 0.5 - c("y1")
    along = F.least(F.greatest(F.coalesce((px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (px - along * dx) * (px - along * dx) + (py - along * dy) * (py - along * dy)


def near_spans(polygons: DataFrame, feet: float, *keep: str) -> DataFrame:
    """n, first and last of the runs of cells whose centre is at most ``feet`` from an edge of a polygon (column rings), with ``keep``.

    A run comes for each piece of an edge. What is near a piece is convex: two circles and the strip
    between them, whose ends on the row are found by roots, a little wide, and tested.
    """
    c, r = F.col, F.lit(feet + 1e-6)
    over = F.sequence(F.floor(F.least("y1", "y2") - feet - 0.5), F.ceil(F.greatest("y1", "y2") + feet - 0.5))
    rows = _pieces(polygons, *keep).withColumns({"dx": c("x2") - c("x1"), "dy": c("y2") - c("y1")}).withColumn("square", c("dx") * c("dx") + c("dy") * c("dy"))
    rows = rows.withColumn("n", F.explode(over)).withColumns({"py": c("n") + 0.5 - c("y1"), "py2": c("n") + 0.5 - c("y2")})
    half = {f"h{k}": F.when(F.abs(p) <= r, F.sqrt(r * r - p * p)) for k, p in ((1, c("py")), (2, c("py2")))}
    side = {f"s{k}": (c("py") * c("dx") + sign * r * F.sqrt("square")) / F.nullif(c("dy"), F.lit(0.0)) for k, sign in ((1, -1), (2, 1))}
    end = {f"t{k}": (along - c("py") * c("dy")) / F.nullif(c("dx"), F.lit(0.0)) for k, along in ((1, F.lit(0.0)), (2, c("square")))}
    rows = rows.withColumns(half | side | end)
    rows = rows.withColumns({"l": F.greatest(F.least("s1", "s2"), F.least("t1", "t2")), "h": F.least(F.greatest("s1", "s2"), F.greatest("t1", "t2"))})  # null: no bound
    strip = ((c("dy") != 0) | (F.abs("py") <= r)) & ((c("dx") != 0) | (c("py") * c("dy")).between(F.lit(0.0), c("dy") * c("dy"))) & (c("l") <= c("h"))
    rows = rows.withColumn("strip", strip)
    west, east = (f(c("x1") + k * c("h1"), c("x2") + k * c("h2"), F.when(c("strip"), c("x1") + c(x))) for f, k, x in ((F.least, -1, "l"), (F.greatest, 1, "h")))
    tried = rows.withColumns({"low": F.ceil(west - 0.5), "high": F.floor(east - 0.5)}).select(*keep, "n", "x1", "dx", "dy", "py", "square", "low", "high")

    def near(e: Column) -> Column:  # as in ``_squared``
        px = e + 0.5 - c("x1")
        along = F.least(F.greatest(F.coalesce((px * c("dx") + c("py") * c("dy")) / F.nullif(c("square"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.pow(px - along * c("dx"), F.lit(2)) + F.pow(c("py") - along * c("dy"), F.lit(2)) <= feet * feet

    # a cell at an end that isn't near was let in by the 1e-6 feet: the next one is then the first, or there is none
    first, last = (F.when(near(c(x)), c(x)).otherwise(c(x) + step).alias(name) for x, step, name in (("low", 1, "first"), ("high", -1, "last")))
    return tried.select(*keep, "n", first, last)


#: Cells of a row that are one number, a bit each.
WORD = 64


def packed_spans(spans: DataFrame, *keep: str, rim: int = 0) -> DataFrame:
    """n, word and cells of runs of cells (n, first, last): a row for each run and word, cells its bits there, the lowest in the west; with ``keep``.

    With a ``rim`` the first and last bits of a word, as many on each side, are cells of the words beside it.
    """
    c, ones, side = F.col, F.lit(-1).cast("long"), WORD - 2 * rim
    words = spans.withColumn("word", F.explode(F.when(c("last") >= c("first"), F.sequence(F.floor((c("first") - rim) / side), F.floor((c("last") + rim) / side)))))
    start = c("word") * side - rim
    low = F.greatest(c("first") - start, F.lit(0)).cast("int")
    idle = F.greatest(F.lit(WORD - 1) - (c("last") - start), F.lit(0)).cast("int")
    cells = F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, idle))
    return words.select(*keep, c("n").cast("int").alias("n"), "word", cells.alias("cells"))


def near_edges(polygons: DataFrame, feet: float, *keep: str, touching: bool = True, once: bool = True) -> DataFrame:
    """e, n of cells whose centre is at most ``feet`` (not ``touching``: less) from an edge of a polygon (column rings), with ``keep``.

    Edges are cut into pieces of 64 feet, so a piece looks at few cells and no ring travels with them.
    Without ``once`` a cell comes for each piece that it is near, for callers that group by cell.
    """
    c, piece = F.col, _pieces(polygons, *keep)
    over = lambda x: F.explode(F.sequence(F.floor(F.least(f"{x}1", f"{x}2") - feet - 0.5), F.ceil(F.greatest(f"{x}1", f"{x}2") + feet - 0.5)))
    tried = piece.select("*", over("x").alias("e")).select("*", over("y").alias("n"))
    far = _squared(c("e"), c("n"))
    found = tried.where(far <= feet * feet if touching else far < feet * feet).select(*keep, c("e").cast("int").alias("e"), c("n").cast("int").alias("n"))
    return found.distinct() if once else found


def class_grid(grid: DataFrame, buildings: DataFrame, structures: DataFrame, hydro: DataFrame, land: DataFrame, buffer: float = 5.0, water_first: bool = True, tolerance: float = 5.0) -> DataFrame:
    """e, n, class of a grid's cells (e, n, height, veg) by polygons (column rings) of buildings, other structures, hydro structures and land.

    A cell is in a polygon by its centre; near an obstruction is inside, or at most ``buffer`` from
    an edge, of all but land. Masks are runs of cells in rows, added up as bits of words of WORD
    cells, which the grid's cells look up; holes in plants are filled afterwards.
    """
    kinds = {"building": buildings, "land": land, "hydro": hydro, "close": structures}
    marks = [row_spans(shape.select("rings")).withColumn("kind", F.lit(kind)) for kind, shape in kinds.items()]
    marks += [near_spans(shape.select("rings"), buffer).withColumn("kind", F.lit("close")) for shape in (buildings, structures, hydro)]
    packed = reduce(lambda a, b: a.unionByName(b), (packed_spans(m, "kind") for m in marks))
    words = packed.groupBy("n", "word").agg(*(F.bit_or(F.when(F.col("kind") == kind, F.col("cells"))).alias(kind) for kind in kinds))
    cells = grid.groupBy("e", "n").agg(*(F.max(F.col(x).cast("double")).alias(x) for x in ("height", "veg")))
    met = cells.withColumn("word", F.floor(F.col("e") / WORD)).join(words.hint("merge"), ["n", "word"], "left")
    has = {kind: F.coalesce(F.getbit(kind, F.pmod("e", F.lit(WORD)).cast("int")) > 0, F.lit(False)) for kind in kinds}
    near = has["building"] | has["hydro"] | has["close"]
    masked = met.select("e", "n", "height", "veg", *(has[kind].alias(kind) for kind in ("building", "land", "hydro")), near.alias("near"))
    return fill_vegetation(classify(masked, water_first, tolerance).select("e", "n", "class"))


TILE_SCHEMA = "ke int, kn int, heights binary, classes binary"


def split_tiles(cells: DataFrame) -> DataFrame:
    """ke, kn, heights and classes of the tiles that ``kept_tiles`` keeps, dense: cells (e, n, h_in, class) not there are 0 and water.

    heights are 16-bit, classes 8-bit numbers, cell by cell from west to east, in each column from
    south to north. A tile has 250,000 cells at most, so a group is small.
    """
    keyed = cells.select("e", "n", "h_in", "class", tiles.tile_key(F.col("e")).cast("int").alias("ke"), tiles.tile_key(F.col("n")).cast("int").alias("kn"))

    def dense(table: pa.Table) -> pa.Table:
        ke, kn = table.column("ke")[0].as_py(), table.column("kn")[0].as_py()
        at = (table.column("e").to_numpy() - ke * tiles.SIDE) * tiles.SIDE + table.column("n").to_numpy() - kn * tiles.SIDE
        heights, classes = np.zeros(tiles.SIDE**2, "<u2"), np.full(tiles.SIDE**2, WATER, np.uint8)
        heights[at], classes[at] = table.column("h_in").to_numpy(), table.column("class").to_numpy()
        keep = heights.any() or (classes != WATER).any()
        out = pa.table({"ke": pa.array([ke], pa.int32()), "kn": pa.array([kn], pa.int32()), "heights": pa.array([heights.tobytes()], pa.binary()), "classes": pa.array([classes.tobytes()], pa.binary())})
        return out if keep else out.slice(0, 0)

    return keyed.groupBy("ke", "kn").applyInArrow(dense, TILE_SCHEMA)


def tile_cells(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """ke, kn, e, n, h_in, class of all cells of the wanted tiles (ke, kn); tiles that ``held`` doesn't have are 0 and water."""
    rows = wanted.select("ke", "kn").distinct().join(held.select("ke", "kn", "heights", "classes"), ["ke", "kn"], "left")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(tiles.SIDE**2)
        for batch in batches:
            for ke, kn, heights, classes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = np.frombuffer(heights, "<u2") if heights is not None else np.zeros(len(place), "<u2")
                k = np.frombuffer(classes, np.uint8) if classes is not None else np.full(len(place), WATER, np.uint8)
                columns = [np.full(len(place), ke), np.full(len(place), kn), ke * tiles.SIDE + place // tiles.SIDE, kn * tiles.SIDE + place % tiles.SIDE, h, k]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in columns], names=["ke", "kn", "e", "n", "h_in", "class"])

    return rows.mapInArrow(unpack, "ke int, kn int, e int, n int, h_in int, class int")


def tile_range(cells: DataFrame) -> DataFrame:
    """ke, kn, lowest, highest: the least and the largest height of a tile's cells (e, n, h_in)."""
    keys = (tiles.tile_key(F.col("e")).alias("ke"), tiles.tile_key(F.col("n")).alias("kn"))
    return cells.groupBy(*keys).agg(F.min("h_in").alias("lowest"), F.max("h_in").alias("highest"))


def classify(cells: DataFrame, water_first: bool = True, tolerance: float = 5.0) -> DataFrame:
    """class of cells with the masks building, land, hydro, near (within the buffer of an obstruction) and heights height, veg.

    Buildings first; then water and plants in this order, or the other way round.
    """
    water = ~F.col("land") & ~F.col("hydro")
    plants = (F.col("veg") > 0) & (F.col("veg") >= F.col("height") - tolerance) & ~F.col("near")
    rules: list[tuple[Column, int]] = [(F.col("building"), BUILDING), *((water, WATER), (plants, VEGETATION))[:: 1 if water_first else -1]]
    out = F
    for rule, value in rules:
        out = out.when(rule, value)
    return cells.withColumn("class", out.otherwise(NONE))


def without_water(cells: DataFrame) -> DataFrame:
    """Heights of water cells set to 0."""
    return cells.withColumn("h_in", F.when(F.col("class") == WATER, 0).otherwise(F.col("h_in")))
