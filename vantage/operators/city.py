"""Links over stored tiles of terrain: only tiles and rows that a zone needs are read, and a link that leaves the city fails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions import tiles
from vantage.operators import zone

#: The result of a link with a tile that isn't the city's.
OUTSIDE = "OutsideCity"


def outside_links(wanted: DataFrame, city: DataFrame) -> DataFrame:
    """Distinct link_id of links (link_id, ke, kn: a row for each tile) with a tile that isn't in the city (ke, kn)."""
    return wanted.join(city.select("ke", "kn").distinct(), ["ke", "kn"], "left_anti").select("link_id").distinct()


def tile_rows(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """ke, kn, n and heights (500 numbers from west to east) of the rows of wanted tiles (ke, kn) that ``held`` has.

    ``held``: ke, kn, heights as ``raster.split_tiles`` stores them. The semi join is on the columns
    that tables of tiles are partitioned by, so that other tiles' files aren't read.
    """
    stored = held.join(wanted.select("ke", "kn").distinct(), ["ke", "kn"], "left_semi").select("ke", "kn", "heights")
    side = tiles.SIDE
    types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = pa.array(np.arange(0, side * side + 1, side), pa.int32())
        for batch in batches:
            for ke, kn, heights in zip(*(c.to_pylist() for c in batch.columns)):
                grid = np.frombuffer(heights, "<u2").reshape(side, side).T.astype(np.int32)  # stored column by column
                values = pa.ListArray.from_arrays(ends, pa.array(grid.ravel()))
                numbers = [np.full(side, ke), np.full(side, kn), kn * side + np.arange(side)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(numbers, types)), values], names=["ke", "kn", "n", "heights"])

    return stored.mapInArrow(rows, "ke int, kn int, n int, heights array<int>")


def zone_terrain(links: DataFrame, held: DataFrame) -> DataFrame:
    """Cells of the full and the inner zones as ``zone.cell_heights`` gives them, with terrain; in tiles that aren't held it is 0.

    A zone's row is cut at tiles, meets the stored row once, and takes its own part of it along.
    """
    c, side = F.col, tiles.SIDE
    both = zone.zone_rows(links, zone.FULL).unionByName(zone.zone_rows(links, zone.INNER))
    rows = both.withColumn("ke", F.explode(F.sequence(tiles.tile_key(c("e_lo")), tiles.tile_key(c("e_hi"))))).withColumn("kn", tiles.tile_key(c("n")))
    first, last = F.greatest(c("e_lo"), c("ke") * side), F.least(c("e_hi"), c("ke") * side + side - 1)
    rows = rows.withColumns({"first": first.cast("int"), "width": (last - first + 1).cast("int")})
    met = rows.join(tile_rows(zone.zone_tiles(links), held), ["ke", "kn", "n"], "left")
    part = F.coalesce(F.slice("heights", c("first") - c("ke") * side + 1, c("width")), F.array_repeat(F.lit(0), c("width")))
    own = met.withColumn("part", part).drop("heights")
    cells = own.select(*(x for x in own.columns if x != "part"), F.posexplode("part").alias("i", "terrain"))
    return zone.cell_heights(cells.withColumn("e", c("first") + c("i")), "terrain")


def statuses(links: DataFrame, held: DataFrame, city: DataFrame, by_row: bool = True) -> DataFrame:
    """link_id, max_full, max_inner and result; links that leave the city have the result ``OUTSIDE`` and no numbers.

    ``held``: dense tiles (ke, kn, heights); a city tile that isn't held is flat at 0. ``city``: ke, kn.
    A link without cells (too short) has no row.
    """
    outside = outside_links(zone.zone_tiles(links), city)
    inside = links.join(outside, "link_id", "left_anti")
    none = F.lit(None).cast("int")
    failed = outside.select("link_id", none.alias("max_full"), none.alias("max_inner"), F.lit(OUTSIDE).alias("result"))
    return zone.verdicts(zone.fractions(zone_terrain(inside, held), by_row)).unionByName(failed)
