"""Longitude and latitude to plane feet and back: Lambert's conformal conic with two parallels.

Public parameters of EPSG:6539 (New York Long Island, US survey feet) on the GRS80 ellipsoid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid, foot, parallels, origin and false origin.
RADIUS, FLATTENING, FOOT = 6378137.0, 1 / 298.257222101, 1200 / 3937
SOUTH, NORTH = math.radians(40 + 40 / 60), math.radians(41 + 2 / 60)
LATITUDE, LONGITUDE, FALSE_EASTING = math.radians(40 + 10 / 60), math.radians(-74.0), 300000.0
E = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _t(latitude: float) -> float:
    s = math.sin(latitude)
    return math.tan(math.pi / 4 - latitude / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)


def _m(latitude: float) -> float:
    return math.cos(latitude) / math.sqrt(1 - (E * math.sin(latitude)) ** 2)


N = (math.log(_m(SOUTH)) - math.log(_m(NORTH))) / (math.log(_t(SOUTH)) - math.log(_t(NORTH)))
SCALE = RADIUS * _m(SOUTH) / (N * _t(SOUTH) ** N)
ORIGIN = SCALE * _t(LATITUDE) ** N


def to_plane(lat: Column, lon: Column, alt_m: Column) -> Column:
    """Struct easting, northing, altitude in feet."""
    phi = F.radians(lat)
    s = F.sin(phi) * E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))
    rho, theta = F.pow(t, F.lit(N)) * SCALE, (F.radians(lon) - LONGITUDE) * N
    return F.struct(
        ((F.sin(theta) * rho + FALSE_EASTING) / FOOT).alias("easting"), ((F.lit(ORIGIN) - F.cos(theta) * rho) / FOOT).alias("northing"), (alt_m / FOOT).alias("altitude")
    )


def to_degrees(easting: Column, northing: Column, altitude: Column) -> Column:
    """Struct lat, lon, alt_m; four rounds settle the latitude to well below a micrometre."""
    x, y = easting * FOOT - FALSE_EASTING, F.lit(ORIGIN) - northing * FOOT
    t = F.pow(F.sqrt(x * x + y * y) / SCALE, F.lit(1 / N))
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(4):
        s = F.sin(phi) * E
        phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - s) / (1 + s), F.lit(E / 2))) * 2
    return F.struct(F.degrees(phi).alias("lat"), F.degrees(F.atan2(x, y) / N + LONGITUDE).alias("lon"), (altitude * FOOT).alias("alt_m"))
