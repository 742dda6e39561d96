"""Roofs and the places on them to measure from: heights, grid, cliffs, edges, masts."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions import geometry
from vantage.operators.raster import WORD, near_edges, packed_spans, row_spans
from vantage.operators.zone import patches

#: Cells of roofs that go to one group, about, and those that are compared with samples at once.
GROUP, CELLS = 1 << 18, 1 << 16
#: Feet of a side of the squares of elevation that roofs meet (with the foot around it, a row is one word), and roofs for each task that makes cells there.
SQUARE, ROOFS = WORD - 2, 4_000


def heightmap(polygons: DataFrame, elevation: DataFrame, buffer: float = 0.5, limit: float = 180.0) -> DataFrame:
    """bin, e, n, h_in, mask, sw_e, sw_n of every cell in the box around a roof (bin, rings).

    A cell is masked if its south-west corner is inside the outline or nearer than ``buffer`` to it.
    Masked cells have the height of ``elevation`` (e, n, h_in; none: 0) with outliers replaced (see
    ``replace_outliers``), others 0. A roof's masks are words of bits, added up where the roof lies;
    its rows of words meet squares of elevation, each one row with the foot around it, and become
    cells there: cells are never shuffled.
    """
    c = F.col
    box = polygons.select("bin", geometry.bounds(c("rings")).alias("b")).select("bin", *(F.floor(f"b.{low}").cast("int").alias(low) for low in ("west", "south")), *((F.ceil(f"b.{high}") - 1).cast("int").alias(high) for high in ("east", "north")))
    whole = box.select("bin", c("west").alias("first"), c("east").alias("last"), c("west").alias("sw_e"), c("south").alias("sw_n"), F.explode(F.when(c("north") >= c("south"), F.sequence("south", "north"))).alias("n"))
    corner = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y"))))
    moved = polygons.select("bin", corner.alias("rings"))  # a cell's corner is where its middle was
    edges = near_edges(moved, buffer, "bin", touching=False, once=False).select("bin", "n", c("e").alias("first"), c("e").alias("last"))
    masks = (packed_spans(spans, "bin", rim=1) for spans in (row_spans(moved, "bin"), edges))
    packed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), masks, packed_spans(whole, "bin", "first", "last", "sw_e", "sw_n", rim=1))
    own = c("sw_e").isNotNull()  # of the box
    words = packed.groupBy("bin", "n", "word").agg(F.bit_or(F.when(own, c("cells"))).alias("box"), F.bit_or(F.when(~own, c("cells"))).alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("sw_e").alias("sw_e"), F.max("sw_n").alias("sw_n"))
    held = words.where("box IS NOT NULL").withColumn("mask", F.coalesce(c("mask").bitwiseAND(c("box")), F.lit(0).cast("long")))
    column = Window.partitionBy("bin", "word").orderBy("n")
    beside = lambda step: F.when(F.lag("n", step).over(column) == c("n") - step, F.lag("mask", step).over(column))
    held = held.withColumns({"south": beside(1), "north": beside(-1)}).fillna(0, ["south", "north"])
    square = {"pe": c("word").cast("int"), "pn": F.floor(c("n") / SQUARE).cast("int")}
    low, high = (end(x, at).cast("int") for end, x, at in ((F.greatest, "first", c("word") * SQUARE), (F.least, "last", (c("word") + 1) * SQUARE - 1)))
    rows = held.withColumns(square | {"first": low, "last": high}).drop("word").where("last >= first").repartition(max(1, -(-polygons.count() // ROOFS)), "pe", "pn")
    met = rows.join(patches(elevation, SQUARE, 1).hint("merge"), ["pe", "pn"], "left")
    west, line = (c("pe") * SQUARE - 1).alias("west"), ((c("n") - c("pn") * SQUARE + 1) * WORD).alias("line")
    met = met.select("bin", "n", "sw_e", "sw_n", "south", "mask", "north", "box", F.coalesce("heights", F.array_repeat(F.lit(0), WORD * WORD)).alias("heights"), west, line, "first", "last")
    cells = met.withColumn("bit", F.explode(F.sequence(c("first") - c("west"), c("last") - c("west"))))
    # the method that Spark makes of these steps has to stay small, or the JVM doesn't compile it
    height = lambda i, j: F.get("heights", c("line") + c("bit") + (j * WORD + i))
    bits = lambda mask, i, ones: F.call_function("shiftrightunsigned", c(mask), c("bit") + i).bitwiseAND(F.lit(ones).cast("long"))
    total = reduce(add, (bits(mask, i, 1) * height(i, j) for j, mask in ((-1, "south"), (0, "mask"), (1, "north")) for i in (-1, 0, 1) if i or j))
    count = reduce(add, (F.bit_count(bits(mask, -1, 7)) for mask in ("south", "mask", "north"))) - 1
    mean = total / F.nullif(count, F.lit(0))
    h_in = F.when(bits("mask", 0, 1) > 0, F.when(F.abs(height(0, 0) - mean) > limit, F.round(mean)).otherwise(height(0, 0))).otherwise(0).cast("int")
    return cells.where(bits("box", 0, 1) > 0).select("bin", (c("west") + c("bit")).alias("e"), "n", h_in.alias("h_in"), (bits("mask", 0, 1) > 0).alias("mask"), "sw_e", "sw_n")


def grid_samples(cells: DataFrame, spacing: int) -> DataFrame:
    """bin, e, n, h_in and the cliff height (highest neighbour a spacing away) of masked roof cells on the sampling grid.

    ``cells``: bin, e, n, h_in, mask, with the roof's south-west cell (sw_e, sw_n).
    """
    half = spacing // 2
    on = lambda x, low: (F.col(x) - F.col(low) >= half) & ((F.col(x) - F.col(low) - half) % spacing == 0)
    grid = cells.where(on("e", "sw_e") & on("n", "sw_n"))
    steps = F.array(*(F.struct(F.lit(i * spacing).alias("i"), F.lit(j * spacing).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    seen = grid.select("bin", "h_in", "mask", F.explode(steps).alias("s"), "e", "n").select(
        "bin", (F.col("e") + F.col("s.i")).alias("e"), (F.col("n") + F.col("s.j")).alias("n"), "h_in", "mask", ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own")
    )
    met = seen.groupBy("bin", "e", "n").agg(F.max(F.when(F.col("own"), F.col("h_in"))).alias("h_in"), F.max(F.when(~F.col("own"), F.col("h_in"))).alias("next_in"), F.bool_or(F.col("own") & F.col("mask")).alias("sampled"))
    return met.where("sampled").drop("sampled")


def cliff_samples(samples: DataFrame, spacing: int, base: bool = False) -> DataFrame:
    """bin, e, n, k, z_in of points up a wall: where the neighbour is more than a spacing taller, every half spacing past its top; with ``base`` all samples come too, as k 0."""
    rise, low = F.col("next_in") - F.col("h_in"), F.lit(0 if base else 1).cast("long")
    steps = F.when(rise > 12 * spacing, F.floor(rise / (6 * spacing)) + 1).otherwise(0)
    tall = samples.select("bin", "e", "n", "h_in", F.explode(F.when(steps >= low, F.sequence(low, steps))).alias("k"))
    return tall.select("bin", "e", "n", F.col("k").cast("int").alias("k"), (F.col("h_in") + F.col("k") * 6 * spacing).cast("int").alias("z_in"))


def perimeter_samples(polygons: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """bin, ring, step, x, y, h_in of points every ``spacing`` feet along all rings.

    A point takes the height of its masked cell, or of the first masked neighbour from west to
    east, each from south to north; with none it is skipped. ``polygons``: bin, rings.

    A cell learns by nine bits which cells around it have points, and only then gives them its height:
    this is all grouping by bin and place, so with both sides dealt out by bin no cell is shuffled.
    """
    ends = polygons.select("bin", F.posexplode("rings").alias("ring", "points")).select("bin", "ring", "points", F.posexplode("points").alias("i", "a"))
    edge = ends.withColumn("b", F.get("points", F.col("i") + 1)).where("b IS NOT NULL")
    edge = edge.withColumn("length", F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2))
    run = Window.partitionBy("bin", "ring").orderBy("i")  # a ring's edges
    edge = edge.withColumn("until", F.sum("length").over(run)).withColumn("start", F.col("until") - F.col("length")).where("length > 0")
    steps = F.expr(f"CASE WHEN ceil(until / {spacing}) > ceil(start / {spacing}) THEN sequence(ceil(start / {spacing}), ceil(until / {spacing}) - 1) END")
    points = edge.withColumn("step", F.explode(steps)).withColumn("t", (F.col("step") * spacing - F.col("start")) / F.col("length"))
    points = points.select("bin", "ring", F.col("step").cast("int").alias("step"), (F.col("a.x") + F.col("t") * (F.col("b.x") - F.col("a.x"))).alias("x"), (F.col("a.y") + F.col("t") * (F.col("b.y") - F.col("a.y"))).alias("y"))
    box = cells.groupBy("bin").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "en" for f in (F.min, F.max)))
    held = points.join(box.hint("merge"), "bin").select("bin", "ring", "step", "x", "y", *(F.greatest(F.least(F.floor(x), F.col(f"max_{c}")), F.col(f"min_{c}")).alias(f"c{c}") for x, c in (("x", "e"), ("y", "n"))))
    order = [(0, 0), *((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)]
    places = [F.struct(F.lit(r).alias("r"), F.lit(1 << r).alias("bit"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(False).alias("point")) for r, (i, j) in enumerate(order)]
    point = F.struct(F.lit(0).alias("r"), F.lit(1).alias("bit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("point"))  # a row of its own, which goes along
    names = ("ring", "step", "x", "y")  # of a point, null for cells
    own = [F.when(F.col("s.point"), F.col(x)).alias(x) for x in names]
    tried = held.withColumn("s", F.explode(F.array(*places, point))).select("bin", (F.col("ce") + F.col("s.i")).alias("e"), (F.col("cn") + F.col("s.j")).alias("n"), *own, F.col("s.bit").alias("bits"))
    met = cells.where("mask").select("bin", "e", "n", "h_in").unionByName(tried, allowMissingColumns=True).groupBy("bin", "e", "n", *names).agg(F.max("h_in").alias("h_in"), F.bit_or("bits").alias("bits"))
    given = met.where("bits IS NOT NULL AND (h_in IS NOT NULL OR step IS NOT NULL)").withColumn("s", F.explode(F.array(*places))).where(F.col("bits").bitwiseAND(F.col("s.bit")) > 0)
    found = given.groupBy("bin", (F.col("e") - F.col("s.i")).alias("ce"), (F.col("n") - F.col("s.j")).alias("cn"), *names).agg(F.min_by("h_in", "s.r").alias("h_in"))
    both = found.withColumn("h_in", F.max("h_in").over(Window.partitionBy("bin", "ce", "cn")))
    return both.where("step IS NOT NULL AND h_in IS NOT NULL").select("bin", "ring", "step", "x", "y", "h_in")


def _uncrowded(rows: DataFrame, radius: float) -> DataFrame:
    """Rows (bin, x, y, _edge, ..) but those beside the edge with an edge point of their roof nearer than ``radius``.

    Edge points go to the blocks of 8 radii that they reach, and a block's rows look at those there:
    a window by bin and block, so rows dealt out by bin are not shuffled.
    """
    side, edge = 8 * max(radius, 1e-9), F.col("_edge")
    block = lambda x: F.floor(x / side)
    reached = lambda x: F.explode_outer(F.when(edge, F.sequence(block(F.col(x) - side / 6), block(F.col(x) + side / 6))).otherwise(F.array(block(F.col(x)))))
    placed = rows.withColumn("_cx", reached("x")).withColumn("_cy", reached("y"))
    marks = F.collect_list(F.when(edge, F.struct("x", "y"))).over(Window.partitionBy("bin", "_cx", "_cy"))
    own = F.col("_cx").eqNullSafe(block(F.col("x"))) & F.col("_cy").eqNullSafe(block(F.col("y")))
    near = lambda p: (p["x"] - F.col("x")) * (p["x"] - F.col("x")) + (p["y"] - F.col("y")) * (p["y"] - F.col("y")) < radius * radius
    crowded = F.col("bin").isNotNull() & F.coalesce(F.exists("_marks", near), F.lit(False))
    return placed.withColumn("_marks", marks).where(own & (edge | ~crowded)).drop("_cx", "_cy", "_marks")


def cull_near(points: DataFrame, edge: DataFrame, radius: float) -> DataFrame:
    """Points (bin, x, y, ..) with no edge point of their roof nearer than ``radius``."""
    rows = points.withColumn("_edge", F.lit(False)).unionByName(edge.select("bin", "x", "y", F.lit(True).alias("_edge")), allowMissingColumns=True)
    return _uncrowded(rows, radius).where("NOT _edge").drop("_edge")


def mast_points(points: DataFrame, offset: float) -> DataFrame:
    """Points (bin, x, y, z, place) with measure_z: of those one above the other only the highest is raised; ties go to the first place."""
    top = Window.partitionBy("bin", "x", "y").orderBy(F.desc("z"), "place")
    return points.withColumn("_n", F.row_number().over(top)).withColumn("measure_z", F.when(F.col("_n") == 1, F.col("z") + offset).otherwise(F.col("z"))).drop("_n")


def rooftop_samples(polygons: DataFrame, cells: DataFrame, spacing: float, mast: float) -> DataFrame:
    """bin, place, x, y, z, measure_z: edge points, then grid points, then cliff points; feet.

    With ``polygons`` and ``cells`` dealt out by bin in as many parts (``splits.dealt_by``) nothing is shuffled.
    """
    if spacing < 1:
        raise ValueError("the spacing is one foot at least")
    whole = int(spacing)
    edge = perimeter_samples(polygons, cells, spacing).select("bin", "x", "y", (F.col("h_in") / 12).alias("z"), F.struct(F.lit(0).alias("kind"), "ring", F.col("step").cast("double").alias("p"), F.lit(0.0).alias("q"), F.lit(0).alias("k")).alias("place"))
    inner = cliff_samples(grid_samples(cells, whole), whole, base=True).select("bin", (F.col("e") + 0.5).alias("x"), (F.col("n") + 0.5).alias("y"), (F.col("z_in") / 12).alias("z"), "k")
    placed = inner.select("bin", "x", "y", "z", F.struct(F.when(F.col("k") == 0, 1).otherwise(2).alias("kind"), F.lit(0).alias("ring"), F.col("x").alias("p"), F.col("y").alias("q"), "k").alias("place"))
    rows = edge.withColumn("_edge", F.lit(True)).unionByName(placed.withColumn("_edge", F.lit(False)))
    return mast_points(_uncrowded(rows, spacing / 2).drop("_edge"), mast)


def nearest_status(cells: DataFrame, samples: DataFrame, reach: int) -> DataFrame:
    """bin, e, n and status of the nearest sample (bin, x, y, sample_id, status) of each cell; ties to the smaller id.

    Roofs are dealt to groups of about GROUP cells, and a group's cells and samples come together in one
    task. There a cell looks at its roof's samples in its square of ``reach`` feet and in those around
    it; a sample within ``reach`` is then the nearest, and cells without one go on with twice the
    reach. Samples without a place are left out, and so are cells of roofs without samples. The cells
    are counted first.
    """
    if reach <= 0:
        raise ValueError("the reach is more than nothing")
    groups = max(1, -(-cells.count() // GROUP))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).alias("_group")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    usable = samples.where(placed).select(group("bin"), F.col("bin").alias("roof"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "sample_id", "status")
    wanted = cells.select(group("bin"), "bin", "e", "n")
    schema = cells.select("bin", "e", "n").limit(0).crossJoin(usable.select("status").limit(0)).schema

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        roofs = right.column("roof").combine_chunks().unique()
        at = pc.index_in(left.column("bin").combine_chunks(), value_set=roofs)
        left, at = left.select(["bin", "e", "n"]).filter(at.is_valid()), at.drop_null().to_numpy()
        ids = right.column("sample_id").combine_chunks()
        keys = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
        names = [str(i) for i in range(len(keys))]
        right = right.take(pc.sort_indices(pa.table(dict(zip(names, keys))), sort_keys=[(c, "ascending") for c in names]))
        of = pc.index_in(right.column("roof").combine_chunks(), value_set=roofs).to_numpy()
        x, y = (right.column(c).to_numpy() for c in "xy")
        e, n = (left.column(c).to_numpy() + 0.5 for c in "en")
        part = lambda a: _nearest(*(v[a : a + CELLS] for v in (at, e, n)), of, x, y, float(reach))
        found = np.concatenate([np.zeros(0, np.int64), *(part(a) for a in range(0, len(e), CELLS))])
        return left.append_column("status", right.column("status").take(pa.array(found)))

    return wanted.groupBy("_group").cogroup(usable.groupBy("_group")).applyInArrow(nearest, schema)


def _nearest(at: np.ndarray, e: np.ndarray, n: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """The number of the nearest sample of each place (at: its roof's number), of several the first; of: the samples' roofs."""
    out, rest = np.full(len(e), -1, np.int64), np.arange(len(e))
    roofs = int(of.max(initial=-1)) + 1
    while len(rest):
        column, row = np.floor(x / reach).astype(np.int64), np.floor(y / reach).astype(np.int64)
        west, south = np.full(roofs, np.iinfo(np.int64).max), np.full(roofs, np.iinfo(np.int64).max)
        np.minimum.at(west, of, column)
        np.minimum.at(south, of, row)
        column, row = column - west[of], row - south[of]  # from each roof's own corner
        wide, high = int(column.max()) + 1, int(row.max()) + 1
        key = (of * wide + column) * high + row
        order = np.argsort(key, kind="stable")
        keys, roof = key[order], at[rest]
        at_e, at_n = np.floor(e[rest] / reach).astype(np.int64) - west[roof], np.floor(n[rest] / reach).astype(np.int64) - south[roof]
        low, top = np.clip(at_n - 1, 0, high), np.clip(at_n + 1, -1, high - 1)
        best, which = np.full(len(rest), np.inf), np.full(len(rest), len(x), np.int64)
        for i in (-1, 0, 1):  # the three rows of a column's squares follow each other
            line = (roof * wide + at_e + i) * high
            first, last = np.searchsorted(keys, line + low, "left"), np.searchsorted(keys, line + top, "right")
            size = np.where((at_e + i >= 0) & (at_e + i < wide), np.maximum(last - first, 0), 0)
            for k in range(int(size.max(initial=0))):
                some = np.flatnonzero(size > k)
                sample = order[first[some] + k]
                far = (x[sample] - e[rest[some]]) ** 2 + (y[sample] - n[rest[some]]) ** 2
                nearer = (far < best[some]) | (far == best[some]) & (sample < which[some])
                best[some[nearer]], which[some[nearer]] = far[nearer], sample[nearer]
        done = best <= reach * reach
        out[rest[done]] = which[done]
        rest, reach = rest[~done], reach * 2
    return out
