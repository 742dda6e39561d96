"""Statistical outliers of LiDAR points: those too far from their nearest neighbours, by the spread of a whole file.

Neighbours are found by joins over a grid of cubes whose side fits the place. The finest cube that
holds enough points besides a point's own bounds how far its neighbours can be; they are then looked
for in the few cubes, of about that side, within this bound. Equal points are one row with a number of
copies, so a hot spot neither fills a cube nor multiplies pairs, and dense places have fine cubes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.raster import NOISE

#: Sides of cubes in feet; the widest holds any file, but for the cubes beside it where signs differ.
SIDES = (0.0625, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 1024.0, 8192.0, 2.0**21, 2.0**40)
_AT = ["file", "x", "y", "z"]


def _side(level: str) -> Column:
    return F.element_at(F.array(*map(F.lit, SIDES)), F.col(level) + 1)


def _cube(level: str) -> list[Column]:
    return [F.floor(F.col(axis) / _side(level)).alias(f"c{axis}") for axis in "xyz"]


def _levels(spots: DataFrame, wanted: int) -> DataFrame:
    """Spots with the finest level at which their own cube holds more than ``wanted`` points, else the last."""
    last = len(SIDES) - 1
    each = spots.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level"))
    keyed = each.select("file", "level", *_cube("level"), "copies")
    dense = keyed.groupBy("file", "level", "cx", "cy", "cz").agg(F.sum("copies").alias("held")).where(F.col("held") > wanted)
    own = each.select(*_AT, "level", *_cube("level")).join(dense.drop("held"), ["file", "level", "cx", "cy", "cz"], "left_semi")
    finest = own.groupBy(*_AT).agg(F.min("level").alias("level"))
    return spots.join(finest, _AT, "left").withColumn("level", F.coalesce("level", F.lit(last)))


def _near(asked: DataFrame, spots: DataFrame, wanted: int, reach: bool = False) -> DataFrame:
    """Asked spots (level, and the cubes cx, cy, cz to look in) with total (of the distances to the nearest ``wanted``
    points there, at most ``reach`` away if asked with one), got and far."""
    q = asked.select(*(F.col(c).alias(f"q{c}") for c in _AT), "file", "level", "cx", "cy", "cz", *(["reach"] if reach else []))
    there = spots.join(asked.select("file", "level").distinct(), "file").select("file", "level", *_cube("level"), "x", "y", "z", "copies")
    met = q.join(there, ["file", "level", "cx", "cy", "cz"])
    dx, dy, dz = (F.col(a) - F.col(f"q{a}") for a in "xyz")
    met = met.select("*", F.sqrt(dx * dx + dy * dy + dz * dz).alias("d"))
    met = met.where(F.col("d") <= F.col("reach")) if reach else met
    own = ["qfile", "qx", "qy", "qz"]
    by_distance = Window.partitionBy(*own).orderBy("d", "x", "y", "z")
    # the spot itself comes first; of rank wanted + 2 on nothing can count, which Spark cuts before it shuffles
    near = met.select(*own, "level", "d", "x", "y", "z", "copies").withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= wanted + 1)
    others = F.col("copies") - F.when(F.col("rank") == 1, 1).otherwise(0)
    before = F.coalesce(F.sum(others).over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = near.select(*own, "level", "d", F.greatest(F.least(others, F.lit(wanted) - before), F.lit(0)).alias("n"))
    found = taken.groupBy(*own, "level").agg(F.sum(F.col("n") * F.col("d")).alias("total"), F.sum("n").alias("got"), F.max(F.when(F.col("n") > 0, F.col("d"))).alias("far"))
    return found.select(*(F.col(f"q{c}").alias(c) for c in _AT), "level", "total", "got", "far")


def _over(asked: DataFrame, reach: Column) -> DataFrame:
    """A row for each cube of its level within ``reach`` of an asked spot along each axis."""
    for axis in "xyz":
        low, high = (F.floor((F.col(axis) + sign * reach) / _side("level")) for sign in (-1, 1))
        asked = asked.withColumn(f"c{axis}", F.explode(F.sequence(low, high)))
    return asked


def neighbour_distances(points: DataFrame, wanted: int = 12) -> DataFrame:
    """file, x, y, z of different points, copies, and mean: the mean distance to the ``wanted`` nearest other points of the file.

    Points are in space (x, y, z). Copies are neighbours at distance 0. Where a file has fewer points the mean
    is of all others there are, and null for a point alone. Points with a null or NaN coordinate are left out.
    """
    sound = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    spots = sound.groupBy(F.col("file"), *(F.col(c).cast("double").alias(c) for c in "xyz")).agg(F.count(F.lit(1)).alias("copies"))
    still = spots.where(F.col("copies") > wanted).select(*_AT, F.lit(0.0).alias("mean"))
    placed = _levels(spots, wanted).where(F.col("copies") <= wanted)
    bounds = _near(placed.select(*_AT, "level", *_cube("level")), spots, wanted)
    full = F.col("got") == wanted
    level = F.size(F.filter(F.array(*map(F.lit, SIDES)), lambda side: side < F.col("far"))).alias("level")
    close = _near(_over(bounds.where(full).select(*_AT, level, F.col("far").alias("reach")), F.col("reach")), spots, wanted, True)
    rest = _near(_over(bounds.where(~full).select(*_AT, "level"), _side("level")), spots, wanted)
    mean = (F.col("total") / F.nullif("got", F.lit(0))).alias("mean")
    means = still.unionByName(close.select(*_AT, mean)).unionByName(rest.select(*_AT, mean))
    return spots.join(means, _AT).select(*_AT, "copies", "mean")


def mark_outliers(points: DataFrame, wanted: int = 12, multiplier: float = 4.0) -> DataFrame:
    """Points (file, x, y, z, class, ..) with class 7 where they are outliers of their file; noise (7, 18) is neither asked nor counted.

    An outlier's mean distance to its ``wanted`` nearest neighbours is more than ``multiplier`` sample
    standard deviations above the mean of all points' distances in the file. Null files are one file;
    a point with a null or NaN coordinate, and the only point of a file, keep their class.
    """
    noise, rest = F.col("class").isin(*NOISE), F.coalesce(F.col("class"), F.lit(-1))
    asked = points.where(~rest.isin(*NOISE)).select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    means = neighbour_distances(asked, wanted).where("mean IS NOT NULL")
    n, s, q = F.sum("copies"), F.sum(F.col("copies") * F.col("mean")), F.sum(F.col("copies") * F.col("mean") * F.col("mean"))
    spread = F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    limits = means.groupBy("file").agg((s / n + F.coalesce(spread, F.lit(0.0)) * multiplier).alias("limit"))
    stray = means.join(limits, "file").where(F.col("mean") > F.col("limit")).select(F.col("file").alias("_file"), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    same = (F.coalesce(F.col("file").cast("string"), F.lit("")) == F.col("_file")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    joined = points.join(stray, same, "left")
    marked = F.when(~F.coalesce(noise, F.lit(False)) & F.col("_file").isNotNull(), F.lit(7)).otherwise(F.col("class")).alias("class")
    return joined.select(*(marked if c == "class" else F.col(c) for c in points.columns))
