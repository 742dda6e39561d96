"""Polygons as rings of points: WKT, Esri rings, containment, edges, buffers, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def parse_wkt(text: Column) -> Column:
    """Rings of a POLYGON or of the first polygon of a MULTIPOLYGON; null for anything else."""
    clean = F.upper(F.trim(text))
    body = F.when(clean.rlike(r"^POLYGON\s*\("), F.regexp_extract(clean, r"^POLYGON\s*\((.*)\)$", 1)).when(
        clean.rlike(r"^MULTIPOLYGON\s*\("), F.regexp_extract(clean, r"^MULTIPOLYGON\s*\(\s*\((.*?\))\s*\)\s*[,)]", 1)
    )
    rings = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), 1)

    def point(pair: Column) -> Column:
        numbers = F.split(F.trim(pair), r"\s+")
        return F.struct(F.get(numbers, 0).try_cast("double").alias("x"), F.get(numbers, 1).try_cast("double").alias("y"))

    parsed = F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point))
    whole = F.forall(parsed, lambda ring: (F.size(ring) >= 4) & F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when((F.size(rings) > 0) & whole, parsed)


def rings_to_wkt(rings: Column) -> Column:
    """WKT of Esri rings (arrays of [x, y]), all in one POLYGON; empty text for null or none."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p[0], p[1])), ", "), F.lit(")"))
    return F.when(F.size(F.coalesce(rings, F.array().cast("array<array<array<double>>>"))) > 0, F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))).otherwise("")


def bounds(rings: Column) -> Column:
    """Struct west, south, east, north of all points."""
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def edges(rings: Column) -> Column:
    """Array of structs (x1, y1, x2, y2)."""
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.flatten(F.transform(rings, lambda ring: F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), pair)))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside by the even-odd rule (holes are outside)."""
    crossed = F.filter(
        edges(rings), lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])
    )
    return F.size(crossed) % 2 == 1


def crossings(sides: Column, y: Column) -> Column:
    """Sorted places where edges (see ``edges``) cross a northing; the inside is between the first and second, the third and fourth, .."""
    crossed = F.filter(sides, lambda s: (s["y1"] > y) != (s["y2"] > y))
    return F.sort_array(F.transform(crossed, lambda s: (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))


def distance_to_edge(rings: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the nearest edge."""

    def squared(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        along = F.coalesce(((x - s["x1"]) * dx + (y - s["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        ex, ey = s["x1"] + t * dx - x, s["y1"] + t * dy - y
        return ex * ex + ey * ey

    return F.sqrt(F.array_min(F.transform(edges(rings), squared)))


def within(rings: Column, x: Column, y: Column, feet: float) -> Column:
    """Inside, or at most ``feet`` from an edge."""
    return contains(rings, x, y) | (distance_to_edge(rings, x, y) <= feet)


def _passes(s: Column, box: tuple[Column, Column, Column, Column], inside: bool = False) -> Column:
    """Whether an edge shares a point with a box, or (``inside``) with its interior; after Liang and Barsky."""
    west, south, east, north = box
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    low, high, out = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, s["x1"] - west), (dx, east - s["x1"]), (-dy, s["y1"] - south), (dy, north - s["y1"])):
        r = q / F.nullif(p, F.lit(0.0))
        out = out & ((p != 0) | ((q > 0) if inside else (q >= 0)))
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
    return out & ((low < high) if inside else (low <= high))


def meets_box(rings: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a polygon and a box share a point: an edge passes the box, or one holds the other."""
    return F.exists(edges(rings), lambda s: _passes(s, (west, south, east, north))) | contains(rings, west, south)


def holds_box(rings: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a box is wholly in a polygon, whose edges it may touch: its middle is, and no edge passes its interior."""
    crossed = F.exists(edges(rings), lambda s: _passes(s, (west, south, east, north), inside=True))
    return contains(rings, (west + east) / 2, (south + north) / 2) & ~crossed


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Strict overlap of (west, south, east, north): touching isn't enough."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])
