"""Tile arithmetic on the one-foot grid: 500-foot tiles inside named 2500-foot tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, LAS_SIDE, HIGHEST = 500, 2500, 2_000_000


def component(feet: Column) -> Column:
    """The part of a name for a coordinate: thousands cut to 0, 2, 5 or 7."""
    block = F.floor(feet / LAS_SIDE).cast("int")
    return F.floor(block / 4).cast("int") * 10 + F.element_at(F.array(F.lit(0), F.lit(2), F.lit(5), F.lit(7)), block % 4 + 1)


def component_feet(part: Column) -> Column:
    return part * 1000 + F.when((part % 10).isin(2, 7), 500).otherwise(0)


def las_name(e: Column, n: Column) -> Column:
    """Components as a name; eastings from 1000 on start over, and an easting of 0 isn't written."""
    short = F.when(e >= 1000, e - 1000).otherwise(e)
    return F.when(short == 0, n.cast("string")).otherwise(F.format_string("%d%03d", short, n))


def parse_las_name(name: Column) -> Column:
    """Struct (e, n) of components; null for what isn't a name. Eastings below 500 are from 1000 on."""
    n = F.expr("1").cast("int") * F.right(name, F.lit(3)).try_cast("int")
    head = F.when(F.length(name) > 3, F.expr("1").cast("int") * F.substr(name, F.lit(1), F.length(name) - 3).try_cast("int")).otherwise(1000)
    e = F.when(head < 500, head + 1000).otherwise(head)
    fits = name.rlike(r"^[0-9]{1,6}\z") & (n % 10).isin(0, 2, 5, 7) & (e % 10).isin(0, 2, 5, 7)
    return F.when(fits, F.struct(e.alias("e"), n.alias("n")))


def tile_key(feet: Column) -> Column:
    """A coordinate's 500-foot index."""
    return F.floor(feet / SIDE).cast("int")


def tile_id(ke: Column, kn: Column) -> Column:
    """The name of the tile with these 500-foot indexes."""
    return F.concat(las_name(component(ke * SIDE), component(kn * SIDE)), F.lit("_"), F.format_string("%d%d", F.pmod(ke, F.lit(5)), F.pmod(kn, F.lit(5))))


def parse_tile_id(name: Column) -> Column:
    """Struct (ke, kn) of 500-foot indexes of a tile's name, null for what isn't one."""
    las = parse_las_name(F.substring_index(name, "_", 1))
    x, y = (F.substring(F.substring_index(name, "_", -1), i, 1).try_cast("int") for i in (1, 2))
    fits = las.isNotNull() & name.rlike(r"^[0-9]+_[0-4][0-4]\z")
    return F.when(fits, F.struct((F.floor(component_feet(las["e"]) / SIDE) + x).cast("int").alias("ke"), (F.floor(component_feet(las["n"]) / SIDE) + y).cast("int").alias("kn")))


def packed(ke: Column, kn: Column) -> Column:
    """Both components and both places within, in 16 + 16 + 8 + 8 bits."""
    parts = ((component(ke * SIDE), 0), (component(kn * SIDE), 16), (F.pmod(ke, F.lit(5)), 32), (F.pmod(kn, F.lit(5)), 40))
    out = None
    for value, bits in parts:
        moved = F.shiftleft(value.cast("long"), bits)
        out = moved if out is None else out.bitwiseOR(moved)
    return out


def ortho_name(las: Column) -> Column:
    return F.concat(F.lpad(las, 6, "0"), F.lit(".jp2"))


def valid_coordinate(feet: Column) -> Column:
    return feet.between(0, HIGHEST)


def valid_altitude(feet: Column) -> Column:
    return feet.between(-5000, 5000)


def valid_frequency(hertz: Column) -> Column:
    return hertz.between(1e3, 200e9)


def valid_gps(lat: Column, lon: Column) -> Column:
    """Whether degrees are near enough to be projected."""
    # The lowest and highest latitude and longitude.
    return lat.between(40.2, 41.15) & lon.between(-77.2, -72.0)


def relative(point: Column, base: Column) -> Column:
    """Struct e, n, z of a point (e, n, z) as seen from another."""
    return F.struct(*((point[c] - base[c]).alias(c) for c in "enz"))
