"""Queries by name, each with the SQL that gives its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import geometry, normalize, projection, tiles
from vantage.operators import city, filings, lidar, raster, rooftop, terrain, zone
from vantage.plans import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# Filings


def _digest(df: DataFrame, *fields: str) -> DataFrame:
    """The columns of an obstruction query, with fields taken back out of its JSON."""
    return df.select("bin", "tax_lot_bbl", "output_geometry", "height_roof", "type", *(F.get_json_object("props", f"$.{f}").alias(f) for f in fields))


def _resolved_sql(jobs: str, order: str, kind: str, fields: str, where: str = "") -> str:
    return f"""
one AS ({jobs} QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {order}) = 1)
SELECT one.bin, coalesce(base, bbl) AS tax_lot_bbl, geom AS output_geometry, tall.height AS height_roof, '{kind}' AS type, {fields}
FROM one LEFT JOIN condos ON billing = bbl JOIN lots ON lot = coalesce(base, bbl) LEFT JOIN tall ON tall.bin = one.bin {where}"""


_JOB_FIELDS = "house || ' ' || borough AS street_addr, system AS job_application_system, job AS job_id"
_YEAR = f"DATE '{S.AS_OF}' - INTERVAL 1 YEAR"


@query(_with(S.FILINGS_SQL, _resolved_sql(f"SELECT * FROM fresh WHERE day >= {_YEAR}", "day DESC, job", "recent_job_applications", _JOB_FIELDS)))
def filings_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(filings.recent_job_applications(S.filings(spark, sf_dir), S.AS_OF), "street_addr", "job_application_system", "job_id")


@query(_with(S.FILINGS_SQL, _resolved_sql(f"SELECT * FROM fresh WHERE approved >= {_YEAR}", "approved DESC, job", "approved_job_applications", _JOB_FIELDS)))
def filings_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(filings.approved_job_applications(S.filings(spark, sf_dir), S.AS_OF), "street_addr", "job_application_system", "job_id")


_ACTIVE = f"""
active AS (
  SELECT l_orderkey::VARCHAR AS job FROM lineitem WHERE l_partkey NOT IN (0, 1000000, 2000000, 3000000, 4000000)
    AND l_shipdate::DATE + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 100 END >= {_YEAR}
)"""


@query(_with(S.FILINGS_SQL, _ACTIVE, _resolved_sql("SELECT * FROM fresh WHERE job IN (SELECT job FROM active)", "day DESC, job", "active_permits", _JOB_FIELDS)))
def filings_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(filings.active_permits(S.filings(spark, sf_dir), S.AS_OF), "street_addr", "job_application_system", "job_id")


@query(
    _with(
        S.FILINGS_SQL,
        _resolved_sql(f"SELECT * FROM filed WHERE fresh AND status <> 'P' AND day > DATE '{S.AFTER}'", "day NULLS FIRST, bbl", "new_construction_co", "one.day::VARCHAR AS tco_date", "WHERE tall.height IS NOT NULL"),
    )
)
def certificates_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(filings.new_construction_certificates(S.filings(spark, sf_dir), S.AFTER), "tco_date")


@query("""
SELECT (p_partkey + 1000000)::VARCHAR AS bin, (p_partkey % 100)::VARCHAR AS tax_lot_bbl, p_name AS output_geometry, floor(p_retailprice)::DOUBLE AS height_roof,
  'new_construction_footprints' AS type, p_brand AS geom_source, (p_size + 1990)::VARCHAR AS construction_year, p_type AS last_status_type
FROM part WHERE p_size + 1990 >= 2021 AND p_partkey % 9 <> 0 AND p_retailprice IS NOT NULL""")
def footprints_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(filings.new_construction_footprints(S.filings(spark, sf_dir)), "geom_source", "construction_year", "last_status_type")


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return filings.one_per_key(rows, ["o_custkey"], "day", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE NULLS FIRST, o_orderkey) = 1")
def earliest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return filings.one_per_key(rows, ["o_custkey"], "day", "o_orderkey", latest=False)


@query(_with(S.FILINGS_SQL, " needed AS (SELECT DISTINCT bin FROM fresh)", " found AS (SELECT bin, height AS height_roof FROM tall WHERE bin IN (SELECT bin FROM needed)) SELECT * FROM found"))
def semi_needed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.filings(spark, sf_dir)
    return filings.latest_heights(t.bis, t.now, filings.new_jobs(t.bis, t.now))


@query(_with(_ACTIVE + " SELECT DISTINCT job AS job_id FROM active"))
def union_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.filings(spark, sf_dir)
    return filings.active_permit_jobs(t.issuance, t.approved, S.AS_OF)


@query(_with(S.FILINGS_SQL + " SELECT job, coalesce(base, bbl) AS tax_lot_bbl FROM fresh LEFT JOIN condos ON billing = bbl"))
def condo_base_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.filings(spark, sf_dir)
    return filings.tax_lot_of(filings.new_jobs(t.bis, t.now), t.condo_units).select(F.col("job_id").alias("job"), "tax_lot_bbl")


# Scalars


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE floor(o_totalprice) END AS amount FROM orders")
def parse_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise(F.concat(F.lit(" $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" ")))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", normalize.parse_number(shown).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def parse_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    shown = (
        F.when(k == 0, F.date_format(day, "MM/dd/yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(k == 3, F.date_format(day, "MM/dd/yyyy  hh:mm:ss a")).when(k == 4, F.date_format(day, "M/d/yyyy HH:mm")).when(k == 5, "soon").otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )
    return S.table(spark, sf_dir, "orders").select("o_orderkey", normalize.parse_date(shown).alias("day"))


@query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_size % 6 BETWEEN 1 AND 5 THEN (p_size % 6)::VARCHAR || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || lpad((p_partkey % 7919)::VARCHAR, 4, '0') END AS bbl FROM part)
SELECT p_partkey, bbl, bbl[1] AS borough, bbl[2:6] AS block, bbl[7:10] AS lot FROM b""")
def bbl_build_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    bbl = normalize.build_bbl(F.concat(F.lit(" "), c("p_size") % 6), (c("p_partkey") % 100000).cast("string"), (c("p_partkey") % 7919).cast("string"))
    rows = S.table(spark, sf_dir, "part").select("p_partkey", bbl.alias("bbl")).withColumn("parts", normalize.parse_bbl(c("bbl")))
    return rows.select("p_partkey", "bbl", F.col("parts.borough").cast("string").alias("borough"), "parts.block", "parts.lot")


@query("""
SELECT o_orderkey, bin, bin <> '' AND bin NOT IN ('1000000', '2000000', '3000000', '4000000', '5000000') AS valid, regexp_full_match(bin, '[1-5][0-9]{6}') AS shaped
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE (o_custkey % 7 * 1000000)::VARCHAR END AS bin FROM orders)""")
def bin_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise((F.col("o_custkey") % 7 * 1000000).cast("string")).alias("bin"))
    return rows.select("o_orderkey", "bin", normalize.valid_bin(F.col("bin")).alias("valid"), normalize.is_building_id(F.col("bin")).alias("shaped"))


@query("""
WITH names(number, name) AS (VALUES (1, 'MANHATTAN'), (2, 'BRONX'), (3, 'BROOKLYN'), (4, 'QUEENS'), (5, 'STATEN ISLAND'))
SELECT n_nationkey, name, number FROM nation LEFT JOIN names ON number = n_nationkey % 7""")
def borough_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "nation").select("n_nationkey", normalize.borough_name(F.col("n_nationkey") % 7).alias("name"))
    return rows.select("n_nationkey", "name", normalize.borough_number(F.concat(F.lit(" "), F.lower("name"))).alias("number"))


# Tiles

_SPREAD = "SELECT l_orderkey, l_linenumber, 500000 + (l_orderkey * 137 + l_linenumber * 911) % 990000 AS e, (l_partkey * 773) % 400000 AS n FROM lineitem"


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(500000) + (F.col("l_orderkey") * 137 + F.col("l_linenumber") * 911) % 990000).alias("e"), ((F.col("l_partkey") * 773) % 400000).alias("n"))


def _keys() -> tuple[Column, Column]:
    return tiles.tile_key(F.col("e")), tiles.tile_key(F.col("n"))


@query(f"SELECT l_orderkey, l_linenumber, {S.tile_sql('e', 'n')} AS tile_id FROM ({_SPREAD})")
def tile_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir).select("l_orderkey", "l_linenumber", tiles.tile_id(*_keys()).alias("tile_id"))


@query(f"SELECT l_orderkey, l_linenumber, (e // 500 * 500)::INT AS west, (n // 500 * 500)::INT AS south FROM ({_SPREAD})")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _spread(spark, sf_dir).withColumn("t", tiles.parse_tile_id(tiles.tile_id(*_keys())))
    return named.select("l_orderkey", "l_linenumber", (F.col("t.ke") * 500).alias("west"), (F.col("t.kn") * 500).alias("south"))


@query(f"SELECT l_orderkey, l_linenumber, {S.tile_sql('e + 1500', 'n + 500')} AS tile_id FROM ({_SPREAD})")
def tile_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ke, kn = _keys()
    return _spread(spark, sf_dir).select("l_orderkey", "l_linenumber", tiles.tile_id(ke + 3, kn + 1).alias("tile_id"))


_CE, _CN = S.COMPONENT_SQL.format("e"), S.COMPONENT_SQL.format("n")


@query(f"SELECT l_orderkey, l_linenumber, (({_CE})::BIGINT + ({_CN})::BIGINT * 65536 + (e // 500 % 5)::BIGINT * 4294967296 + (n // 500 % 5)::BIGINT * 1099511627776)::BIGINT AS packed FROM ({_SPREAD})")
def tile_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir).select("l_orderkey", "l_linenumber", tiles.packed(*_keys()).alias("packed"))


# Rasters


@query(_with(S.points_sql() + " SELECT * FROM raster"))
def raster_max_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.height_grid(S.points(spark, sf_dir))


_KEEP = f"""
SELECT (e // 500)::INT AS ke, (n // 500)::INT AS kn FROM (SELECT {S.EAST} + p_partkey * 37 % 9000 AS e, {S.NORTH} + p_partkey * 53 % 9000 AS n, CASE WHEN p_size > 45 THEN p_size ELSE 0 END AS h, CASE WHEN p_partkey % 40 = 0 THEN 2 ELSE 3 END AS class FROM part)
GROUP BY ALL HAVING bool_or(h <> 0 OR class <> 3)"""


@query(_KEEP)
def tile_keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cells = S.table(spark, sf_dir, "part").select(
        (F.lit(S.EAST) + c("p_partkey") * 37 % 9000).alias("e"), (F.lit(S.NORTH) + c("p_partkey") * 53 % 9000).alias("n"), F.when(c("p_size") > 45, c("p_size")).otherwise(0).alias("h_in"),
        F.when(c("p_partkey") % 40 == 0, 2).otherwise(3).alias("class"),
    )
    return raster.kept_tiles(cells)


@query("""
WITH px AS (SELECT DISTINCT ON (o_orderkey) o_orderkey // 2000 AS r, o_orderkey % 2000 AS c, (CASE WHEN o_orderkey // 2000 % 3 = 1 THEN 0 ELSE o_custkey % 100 END)::DOUBLE AS feet FROM orders),
cells AS (SELECT (c + 910720)::INT AS e, (275160 - r - 1)::INT AS n, (feet * 12)::INT AS h_in FROM px),
keyed AS (SELECT (e // 500)::INT AS ke, (n // 500)::INT AS kn, e, n, h_in FROM cells)
SELECT * FROM keyed QUALIFY max(h_in) OVER (PARTITION BY ke, kn) > 0""")
def dem_retile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pixels = S.table(spark, sf_dir, "orders").select(F.floor(k / 2000).alias("row"), (k % 2000).alias("col"), F.when(F.floor(k / 2000) % 3 == 1, 0).otherwise(F.col("o_custkey") % 100).cast("double").alias("feet"))
    return raster.retile_elevation(pixels)


_SIDE = 400
_NEAR_SQL = "(SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0)"
_DENSE_SQL = f"""
grid AS (SELECT ({S.EAST} + i)::INT AS e, ({S.NORTH} + j)::INT AS n FROM range({_SIDE}) a(i), range({_SIDE}) b(j)),
cells AS (SELECT g.e, g.n, coalesce((height * 12)::INT, 0) AS h_in, coalesce(points, 0) AS points, CASE WHEN r.e IS NULL THEN 0 WHEN veg > 0 AND veg >= height - 5 THEN 1 ELSE 2 END AS class FROM grid g LEFT JOIN raster r USING (e, n))"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole grid: cells without points have a count of 0 and no class."""
    side = F.sequence(F.lit(S.NORTH), F.lit(S.NORTH + _SIDE - 1))
    grid = spark.range(S.EAST, S.EAST + _SIDE).select(F.col("id").cast("int").alias("e"), F.explode(side).alias("n"))
    known = raster.height_grid(S.points(spark, sf_dir, _SIDE))
    kind = F.when(F.col("height").isNull(), 0).when((F.col("veg") > 0) & (F.col("veg") >= F.col("height") - 5), 1).otherwise(2)
    return grid.join(known, ["e", "n"], "left").select("e", "n", F.coalesce((F.col("height") * 12).cast("int"), F.lit(0)).alias("h_in"), F.coalesce("points", F.lit(0)).alias("points"), kind.alias("class"))


@query(
    _with(
        S.points_sql(_SIDE), _DENSE_SQL,
        f""" near AS (SELECT te AS e, tn AS n, list_sort(list(h_in)) AS v FROM (SELECT e AS te, n AS tn, e + i AS e, n + j AS n FROM cells, {_NEAR_SQL} WHERE points = 0) JOIN cells USING (e, n) WHERE h_in > 0 GROUP BY ALL)
SELECT c.e, c.n, CASE WHEN points > 0 THEN c.h_in ELSE coalesce(v[len(v) // 2 + 1], 0) END AS h_in FROM cells c LEFT JOIN near USING (e, n)""",
    )
)
def gap_fill_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fill_gaps(_dense(spark, sf_dir))


@query(
    _with(
        S.points_sql(_SIDE), _DENSE_SQL,
        f""" near AS (SELECT te AS e, tn AS n, count(*) FILTER (class = 1) AS veg, count(*) AS total FROM (SELECT e AS te, n AS tn, e + i AS e, n + j AS n FROM cells, {_NEAR_SQL} WHERE class = 0) JOIN cells USING (e, n) GROUP BY ALL)
SELECT c.e, c.n, CASE WHEN veg > total // 2 THEN 1 ELSE class END AS class FROM cells c LEFT JOIN near USING (e, n)""",
    )
)
def veg_majority_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fill_vegetation(_dense(spark, sf_dir))


_ROOF_SQL = "roofs AS (SELECT obstruction_id AS bin, e, n, (h_in + CASE WHEN (e * 31 + n * 17) % 23 = 0 THEN 900 ELSE (e + n) % 5 END)::INT AS h_in FROM box_cells)"


def _box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterize(S.rings(S.boxes(spark, sf_dir)), "obstruction_id", "w", "h", "h_in")


def _roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bump = F.when((F.col("e") * 31 + F.col("n") * 17) % 23 == 0, 900).otherwise((F.col("e") + F.col("n")) % 5)
    return _box_cells(spark, sf_dir).select(F.col("obstruction_id").alias("bin"), "e", "n", (F.col("h_in") + bump).cast("int").alias("h_in"))


@query(
    _with(
        S.BOXES_SQL, _ROOF_SQL,
        f""" near AS (SELECT bin, te AS e, tn AS n, sum(h_in) / count(*) AS mean FROM (SELECT bin, e AS te, n AS tn, e + i AS e, n + j AS n FROM roofs, {_NEAR_SQL}) JOIN roofs USING (bin, e, n) GROUP BY ALL)
SELECT bin, e, n, CASE WHEN abs(h_in - mean) > 180 THEN round(mean)::INT ELSE h_in END AS h_in FROM roofs LEFT JOIN near USING (bin, e, n)""",
    )
)
def roof_outlier_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.replace_outliers(_roofs(spark, sf_dir))


_MASKS = "e % 7 = 0 AS building, n % 5 <> 0 AS land, e % 11 = 0 AS hydro, (e + n) % 3 = 0 AS near"


@query(_with(S.points_sql() + f" SELECT e, n, CASE WHEN building THEN 2 WHEN NOT land AND NOT hydro THEN 3 WHEN veg > 0 AND veg >= height - 5 AND NOT near THEN 1 ELSE 0 END AS class FROM (SELECT *, {_MASKS} FROM raster)"))
def terrain_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.height_grid(S.points(spark, sf_dir)).selectExpr("*", *_MASKS.split(", "))
    return raster.classify(cells).select("e", "n", "class")


# Obstructions and terrain


@query(_with(S.BOXES_SQL + " SELECT DISTINCT obstruction_id, (e // 500)::INT AS ke, (n // 500)::INT AS kn FROM box_cells"))
def bbox_tile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.box_tiles(S.boxes(spark, sf_dir), "obstruction_id")


@query(
    _with(
        S.BOXES_SQL,
        f""" others AS (SELECT obstruction_id, ({S.EAST} + obstruction_id::INT * 41 % 2400)::INT AS e, ({S.NORTH} + obstruction_id::INT * 59 % 2400)::INT AS n, w, h FROM boxes)
SELECT a.obstruction_id AS a, b.obstruction_id AS b FROM boxes a JOIN others b ON a.e < b.e + b.w AND b.e < a.e + a.w AND a.n < b.n + b.h AND b.n < a.n + a.h""",
    )
)
def bbox_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, key = S.boxes(spark, sf_dir), F.col("obstruction_id").cast("int")
    others = boxes.select(F.col("obstruction_id").alias("b"), (F.lit(S.EAST) + key * 41 % 2400).alias("e"), (F.lit(S.NORTH) + key * 59 % 2400).alias("n"), "w", "h")
    return terrain.overlapping(boxes.withColumnRenamed("obstruction_id", "a"), others, "a", "b")


@query(_with(S.BOXES_SQL + " SELECT DISTINCT obstruction_id, (x // 500)::INT AS ke, (y // 500)::INT AS kn FROM (SELECT *, unnest(range(e - e % 500 - CASE WHEN e % 500 = 0 THEN 500 ELSE 0 END, e + w + 1, 500)) AS x FROM boxes), LATERAL (SELECT unnest(range(n - n % 500 - CASE WHEN n % 500 = 0 THEN 500 ELSE 0 END, n + h + 1, 500)) AS y)"))
def polygon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.polygon_tiles(S.rings(S.boxes(spark, sf_dir)), "obstruction_id").select("obstruction_id", "ke", "kn")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = terrain.box_tiles(S.boxes(spark, sf_dir), "obstruction_id", "obstruction_type")
    meta = pairs.groupBy("obstruction_id", "obstruction_type").agg(F.collect_set(tiles.tile_id(F.col("ke"), F.col("kn"))).alias("tile_ids"))
    return terrain.obstruction_index(meta)


@query(_with(S.BOXES_SQL + f" SELECT obstruction_type, tile_id, string_agg(obstruction_id, ',' ORDER BY obstruction_id) AS ids FROM (SELECT DISTINCT obstruction_type, obstruction_id, {S.tile_sql('e', 'n')} AS tile_id FROM (SELECT c.e, c.n, obstruction_id, obstruction_type FROM box_cells c JOIN boxes USING (obstruction_id))) GROUP BY ALL"))
def obstruction_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("obstruction_type", "tile_id", F.array_join("ids", ",").alias("ids"))


@query(_with(S.BOXES_SQL + f" SELECT DISTINCT obstruction_type, obstruction_id FROM (SELECT c.e, c.n, obstruction_id, obstruction_type FROM box_cells c JOIN boxes USING (obstruction_id)) WHERE e // 500 = {S.EAST // 500 + 1} AND obstruction_type IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')"))
def distinct_obstructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 6).select(tiles.tile_id(F.lit(S.EAST // 500 + 1), (F.col("id") + S.NORTH // 500).cast("int")).alias("tile_id"))
    return terrain.obstructions_near(wanted, _index(spark, sf_dir), ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"])


@query(_with(S.BOXES_SQL + " SELECT obstruction_id, e, n, h_in FROM box_cells"))
def obstruction_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_cells(spark, sf_dir).select("obstruction_id", "e", "n", "h_in")


@query(_with(S.BOXES_SQL + f" SELECT CASE WHEN w >= 20 THEN obstruction_id || '/' || {S.tile_sql('e', 'n')} ELSE obstruction_id END AS chunk_id, CASE WHEN w >= 20 THEN obstruction_id END AS group_id, count(*) AS cells, max(h_in)::INT AS h_in FROM box_cells WHERE h_in > 0 GROUP BY ALL"))
def obstruction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _box_cells(spark, sf_dir)
    meta = S.boxes(spark, sf_dir).select("obstruction_id", F.when(F.col("w") >= 20, 1000).otherwise(1).alias("w"), F.lit(1000).alias("h"))
    return terrain.split_large(meta, cells.select("obstruction_id", "e", "n", "h_in")).groupBy("chunk_id", "group_id").agg(F.count(F.lit(1)).alias("cells"), F.max("h_in").alias("h_in"))


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    elevation = raster.height_grid(S.points(spark, sf_dir)).select("e", "n", (F.col("height") * 12).cast("int").alias("h_in"))
    return terrain.highest(_box_cells(spark, sf_dir), elevation)


@query(_with(S.points_sql(), S.BOXES_SQL, S.TERRAIN_SQL + " SELECT * FROM terrain"))
def terrain_merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terrain(spark, sf_dir)


@query(_with(S.points_sql(), S.BOXES_SQL + " SELECT obstruction_id, max((height * 12)::INT) / 12 AS ground FROM box_cells JOIN raster USING (e, n) GROUP BY ALL"))
def dem_max_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    elevation = raster.height_grid(S.points(spark, sf_dir)).select("e", "n", (F.col("height") * 12).cast("int").alias("h_in"))
    return terrain.ground_under(S.rings(S.boxes(spark, sf_dir)).drop("e", "n"), elevation, "obstruction_id")


# Links


@query(_with(S.LINKS_SQL + " SELECT link_id, n::INT AS n, e_lo, e_hi FROM zone_rows WHERE alpha = 1.0"))
def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.zone_rows(S.links(spark, sf_dir)).select("link_id", "n", "e_lo", "e_hi")


@query(_with(S.LINKS_SQL + " SELECT link_id, n, e, bottom, top FROM zone_cells WHERE alpha = 1.0"))
def zone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.zone_cells(S.links(spark, sf_dir)).select("link_id", "n", "e", "bottom", "top")


@query(_with(S.LINKS_SQL + " SELECT DISTINCT link_id, (e // 500)::INT AS ke, (n // 500)::INT AS kn FROM zone_cells WHERE alpha = 1.0"))
def zone_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.zone_tiles(S.links(spark, sf_dir))


_ANALYSIS = (S.points_sql(), S.BOXES_SQL, S.TERRAIN_SQL, S.LINKS_SQL)


_SURVEY_SQL = f"""
survey AS (
  SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_suppkey % 40 AS file, ({S.EAST} + (l_orderkey * 7 + l_linenumber * 13) % 100)::DOUBLE AS x, ({S.NORTH} + (l_partkey * 11) % 100)::DOUBLE AS y,
    (l_quantity + CASE WHEN l_orderkey % 101 = 0 AND l_linenumber = 1 THEN 60 + l_partkey % 50 ELSE 0 END)::DOUBLE AS z, CASE l_returnflag WHEN 'R' THEN 7 WHEN 'A' THEN 3 ELSE 2 END AS class FROM lineitem
),
asked AS (SELECT id, file, x, y, z FROM survey WHERE class <> 7),
means AS (
  SELECT a.id, any_value(a.file) AS file, list_avg(min(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)), 12)) AS mean FROM asked a JOIN asked b ON a.file = b.file AND a.id <> b.id GROUP BY a.id
),
limits AS (SELECT file, avg(mean) + 4 * coalesce(stddev_samp(mean), 0) AS most FROM means GROUP BY file)"""


@query(_with(_SURVEY_SQL + " SELECT l_orderkey, l_linenumber, CASE WHEN mean > most THEN 7 ELSE class END::INT AS class FROM survey LEFT JOIN means USING (id) LEFT JOIN limits ON limits.file = means.file"))
def lidar_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points of 40 files, some far above the others; classes after statistical outliers became noise."""
    c = F.col
    stray = F.when((c("l_orderkey") % 101 == 0) & (c("l_linenumber") == 1), 60 + c("l_partkey") % 50).otherwise(0)
    kind = F.when(c("l_returnflag") == "R", 7).when(c("l_returnflag") == "A", 3).otherwise(2)
    points = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_suppkey") % 40).alias("file"), (F.lit(S.EAST) + (c("l_orderkey") * 7 + c("l_linenumber") * 13) % 100).cast("double").alias("x"),
        (F.lit(S.NORTH) + (c("l_partkey") * 11) % 100).cast("double").alias("y"), (c("l_quantity") + stray).cast("double").alias("z"), kind.alias("class"),
    )
    return lidar.mark_outliers(points).select("l_orderkey", "l_linenumber", "class")


@query(_with(*_ANALYSIS, S.FRACTION_SQL + " SELECT link_id, n, e, fraction FROM hits WHERE alpha = 1.0 AND fraction > 0"))
def occlusion_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = zone.fractions(zone.over_terrain(S.links(spark, sf_dir), _terrain(spark, sf_dir), zone.FULL))
    touched = F.explode(F.when(F.col("fraction") > 0, F.array(F.col("fraction").cast("int")))).alias("fraction")  # no filter, see ``zone.zone_rows``
    return cells.select("link_id", "n", "e", touched)


@query(_with(*_ANALYSIS, S.FRACTION_SQL + " SELECT * FROM results"))
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.statuses(S.links(spark, sf_dir), _terrain(spark, sf_dir))


# A city of 16 tiles, five of them without terrain of their own.
_CITY_WIDE = 4
_CITY_SQL = f"""
leaving AS (
  SELECT DISTINCT link_id FROM zone_cells
  WHERE alpha = 1.0 AND NOT ((e // 500) BETWEEN {S.EAST // 500} AND {S.EAST // 500 + _CITY_WIDE - 1} AND (n // 500) BETWEEN {S.NORTH // 500} AND {S.NORTH // 500 + _CITY_WIDE - 1})
)"""


def _city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ke, kn of tiles wholly inside an outline that the links' own reach passes on the east and north."""
    outline = S.rings(S.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(S.EAST).alias("e"), F.lit(S.NORTH).alias("n"), F.lit(500 * _CITY_WIDE + 100).alias("w"), F.lit(500 * _CITY_WIDE + 100).alias("h")))
    return terrain.city_tiles(outline)


@query(
    _with(
        *_ANALYSIS,
        S.FRACTION_SQL,
        _CITY_SQL
        + """
SELECT link_id, CASE WHEN l.link_id IS NULL THEN max_full END AS max_full, CASE WHEN l.link_id IS NULL THEN max_inner END AS max_inner, CASE WHEN l.link_id IS NULL THEN result ELSE 'OutsideCity' END AS result
FROM results LEFT JOIN leaving l USING (link_id)""",
    )
)
def link_outside_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses from stored tiles, for links that stay in the city; others fail."""
    held = raster.split_tiles(_terrain(spark, sf_dir).withColumn("class", F.lit(raster.NONE)))
    return city.statuses(S.links(spark, sf_dir), held, _city(spark, sf_dir))


@query(_with(*_ANALYSIS, S.FRACTION_SQL + " SELECT result, count(*) AS links FROM results GROUP BY ALL"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_status(spark, sf_dir).groupBy("result").agg(F.count(F.lit(1)).alias("links"))


@query(
    _with(
        *_ANALYSIS,
        S.FRACTION_SQL + f""" SELECT link_id, {S.tile_sql('e', 'n')} AS tile_id, (min(e) // 500 * 500)::INT AS west, (min(n) // 500 * 500)::INT AS south, any_value(result) <> 'Unobstructed' AND max(fraction) > 0 AS detected
FROM hits JOIN results USING (link_id) WHERE alpha = 1.0 GROUP BY 1, 2""",
    )
)
def tile_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.tile_overview(S.links(spark, sf_dir), _terrain(spark, sf_dir))


@query(
    _with(
        S.LINKS_SQL + """ SELECT link_id, sum(e_hi - e_lo + 1)::BIGINT AS cells, any_value(tiles) AS tiles, ((sum(e_hi - e_lo + 1) * 7 + any_value(tiles) * 500000) * 3 // 2)::BIGINT AS bytes
FROM zone_rows JOIN (SELECT link_id, count(DISTINCT (e // 500, n // 500)) AS tiles FROM zone_cells WHERE alpha = 1.0 GROUP BY ALL) USING (link_id) GROUP BY link_id"""
    )
)
def analysis_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.costs(S.links(spark, sf_dir))


@query(_with(S.LINKS_SQL + f""" SELECT link_id, 500 + kn * 1000 + ke AS tile, n, e, bottom, top FROM (SELECT *, (e // 500)::INT - {S.EAST // 500} AS ke, (n // 500)::INT - {S.NORTH // 500} AS kn FROM zone_cells WHERE alpha = 1.0) WHERE ke = 1 AND kn = 2"""))
def zone_in_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = zone.zone_in_tile(S.links(spark, sf_dir), S.EAST // 500 + 1, S.NORTH // 500 + 2)
    return cells.select("link_id", F.lit(2501).alias("tile"), "n", "e", "bottom", "top")


@query(_with(S.LINKS_SQL + " SELECT link_id, (sum(e_hi - e_lo + 1) * 5)::BIGINT AS bytes FROM zone_rows GROUP BY link_id"))
def result_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone.result_bytes(zone.costs(S.links(spark, sf_dir)))


#: Rounding keeps the last bits of sines and roots, which engines may give otherwise, out of the comparison.
_ENDS_SQL = f"""
ends AS (
  SELECT c_custkey AS link_id, ({S.EAST} + c_custkey * 17 % 2000)::DOUBLE AS ae, ({S.NORTH} + c_custkey * 29 % 2000)::DOUBLE AS an, (5 + c_custkey % 40)::DOUBLE AS az,
    (40 + c_custkey % 200)::DOUBLE AS de, (30 + c_custkey % 150)::DOUBLE AS dn, (c_custkey % 20)::DOUBLE AS dz FROM customer
)"""


@query(
    _with(
        _ENDS_SQL,
        """
shape AS (SELECT *, sqrt(de * de + dn * dn + dz * dz) AS dist, 299792458.0 / 60e9 / 0.3048006096 AS wave, sqrt(de * de + dn * dn) AS flat FROM ends),
turns AS (SELECT *, 2 * pi() / 90 * step AS turn FROM shape, LATERAL (SELECT unnest(range(91)) AS step)),
sides AS (SELECT *, cos(turn) * (dist + wave / 2) / 2 AS along, sin(turn) * sqrt(wave * dist) / 2 AS across FROM turns)
SELECT link_id, step::INT AS step, round((ae + de / 2 + along * de / flat - across * dn / flat) * 1000)::BIGINT AS e_milli, round((an + dn / 2 + along * dn / flat + across * de / flat) * 1000)::BIGINT AS n_milli FROM sides""",
    )
)
def link_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    milli = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_milli")
    return zone.ellipse(S.links(spark, sf_dir)).select("link_id", "step", milli("e"), milli("n"))


def _latitude_sql() -> str:
    """Five rounds of the conic's inverse as nested expressions."""
    phi = "(pi() / 2 - 2 * atan(t))"
    for _ in range(4):
        s = f"({projection.E!r} * sin({phi}))"
        phi = f"(pi() / 2 - 2 * atan(t * pow((1 - {s}) / (1 + {s}), {projection.E / 2!r})))"
    return phi


@query(
    _with(
        _ENDS_SQL,
        f"""
plane AS (SELECT *, ae * {projection.FOOT!r} - {projection.FALSE_EASTING!r} AS x, {projection.ORIGIN!r} - an * {projection.FOOT!r} AS y FROM ends),
cone AS (SELECT *, pow(sqrt(x * x + y * y) / {projection.SCALE!r}, {1 / projection.N!r}) AS t FROM plane),
globe AS (SELECT *, {_latitude_sql()} AS phi, atan2(x, y) / {projection.N!r} + {projection.LONGITUDE!r} AS meridian FROM cone)
SELECT link_id, round(degrees(phi) * 1e8)::BIGINT AS lat_e8, round(degrees(meridian) * 1e8)::BIGINT AS lon_e8, round(az * {projection.FOOT!r} * 1e6)::BIGINT AS alt_um, round(ae * 1000)::BIGINT AS e_milli, round(an * 1000)::BIGINT AS n_milli FROM globe""",
    )
)
def gps_to_nys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = S.links(spark, sf_dir).select("link_id", projection.to_degrees(F.col("ae"), F.col("an"), F.col("az")).alias("g"))
    both = ends.select("link_id", "g.*", projection.to_plane(F.col("g.lat"), F.col("g.lon"), F.col("g.alt_m")).alias("p"))
    whole = lambda c, times, name: F.round(F.col(c) * times).cast("long").alias(name)
    return both.select("link_id", whole("lat", 1e8, "lat_e8"), whole("lon", 1e8, "lon_e8"), whole("alt_m", 1e6, "alt_um"), whole("p.easting", 1000, "e_milli"), whole("p.northing", 1000, "n_milli"))


# Rooftops

_SPACING = 4
#: Boxes moved by fractions of a foot, so that some corners of cells are near an edge and some are not.
_MOVED_SQL = """
moved AS (SELECT obstruction_id AS bin, e + CASE WHEN h_in % 24 = 0 THEN 0.25 ELSE 0.75 END AS x, n + CASE WHEN w % 2 = 0 THEN 0.25 ELSE 0.75 END AS y, w, h, e, n FROM boxes)"""


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with their outlines moved, as rings; dealt out by bin."""
    c = F.col
    side = lambda flag: F.when(flag, 0.25).otherwise(0.75)
    rows = S.boxes(spark, sf_dir, by_id=True).select(c("obstruction_id").alias("bin"), "w", "h", (c("e") + side(c("h_in") % 24 == 0)).alias("e"), (c("n") + side(c("w") % 2 == 0)).alias("n"))
    return S.rings(rows)


@query(
    _with(
        S.points_sql(),
        S.BOXES_SQL,
        S.TERRAIN_SQL,
        _MOVED_SQL,
        """
box AS (SELECT bin, (e + i)::INT AS ce, (n + j)::INT AS cn, x, y, w, h FROM (SELECT *, unnest(range(w + 1)) AS i FROM moved), LATERAL (SELECT unnest(range(h + 1)) AS j)),
masked AS (SELECT bin, ce AS e, cn AS n, pow(greatest(x - ce, ce - x - w, 0), 2) + pow(greatest(y - cn, cn - y - h, 0), 2) < 0.25 AS mask FROM box),
tall AS (SELECT m.bin, m.e, m.n, m.mask, CASE WHEN m.mask THEN coalesce(t.h_in, 0) ELSE 0 END::INT AS h_in FROM masked m LEFT JOIN terrain t USING (e, n)),
masks AS (SELECT * FROM tall WHERE mask),
moves AS (SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0),
near AS (SELECT bin, e + i AS e, n + j AS n, avg(h_in) AS mean FROM masks, moves GROUP BY ALL)
SELECT t.bin, t.e, t.n, t.mask, CASE WHEN t.mask AND abs(t.h_in - mean) > 180 THEN round(mean)::INT ELSE t.h_in END AS h_in FROM tall t LEFT JOIN near USING (bin, e, n)""",
    )
)
def rooftop_heightmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooftop.heightmap(_moved(spark, sf_dir).select("bin", "rings"), _terrain(spark, sf_dir)).select("bin", "e", "n", "mask", "h_in")


_KINDS = ("building", "structure", "hydro", "land")
_CLASS_SQL = """
ground AS (SELECT e, n, max(h_in) / 12.0 AS height, max(CASE WHEN h_in % 36 = 0 THEN h_in ELSE 0 END) / 12.0 AS veg FROM box_cells GROUP BY ALL),
shapes AS (SELECT h_in // 12 % 4 AS kind, e + 0.5 AS x0, n + 0.5 AS y0, e + w + 0.25 AS x1, n + h + 0.25 AS y1 FROM boxes),
marked AS (
  SELECT e, n, height, veg, bool_or(kind = 0 AND far = 0) AS building, bool_or(kind = 2 AND far = 0) AS hydro, bool_or(kind = 3 AND far = 0) AS land, bool_or(kind <> 3 AND far <= 25) AS near FROM (
    SELECT g.*, kind, pow(greatest(x0 - g.e - 0.5, g.e + 0.5 - x1, 0), 2) + pow(greatest(y0 - g.n - 0.5, g.n + 0.5 - y1, 0), 2) AS far
    FROM ground g LEFT JOIN shapes ON x0 - 5.5 <= g.e AND g.e <= x1 + 4.5 AND y0 - 5.5 <= g.n AND g.n <= y1 + 4.5)
  GROUP BY ALL
),
classes AS (SELECT e, n, CASE WHEN coalesce(building, false) THEN 2 WHEN NOT coalesce(land, false) AND NOT coalesce(hydro, false) THEN 3 WHEN veg > 0 AND veg >= height - 5 AND NOT coalesce(near, false) THEN 1 ELSE 0 END AS class FROM marked),
open AS (SELECT a.e, a.n, count(*) AS total, count(*) FILTER (b.class = 1) AS green FROM classes a JOIN classes b ON abs(a.e - b.e) <= 1 AND abs(a.n - b.n) <= 1 AND (a.e <> b.e OR a.n <> b.n) WHERE a.class = 0 GROUP BY ALL)"""


def _class_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    boxes = S.boxes(spark, sf_dir)
    grid = _box_cells(spark, sf_dir).groupBy("e", "n").agg((F.max("h_in") / 12.0).alias("height"), (F.max(F.when(c("h_in") % 36 == 0, c("h_in")).otherwise(0)) / 12.0).alias("veg"))
    outline = S.rings(boxes.select(F.floor(c("h_in") / 12).cast("int").alias("feet"), (c("e") + 0.5).alias("e"), (c("n") + 0.5).alias("n"), (c("w") - 0.25).alias("w"), (c("h") - 0.25).alias("h")))
    shapes = [outline.where(c("feet") % 4 == k) for k, _ in enumerate(_KINDS)]
    return raster.class_grid(grid, *shapes)


@query(_with(S.BOXES_SQL, _CLASS_SQL + " SELECT c.e, c.n, CASE WHEN green > total // 2 THEN 1 ELSE class END::INT AS class FROM classes c LEFT JOIN open USING (e, n)"))
def class_from_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_grid(spark, sf_dir)


_SPLIT_SQL = """
held AS (SELECT e, n, max(h_in)::INT AS h_in, max(CASE WHEN h_in % 36 = 0 THEN 1 ELSE 0 END)::INT AS class FROM box_cells GROUP BY ALL)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_cells(spark, sf_dir).groupBy("e", "n").agg(F.max("h_in").alias("h_in"), F.max((F.col("h_in") % 36 == 0).cast("int")).alias("class"))


@query(_with(S.BOXES_SQL, _SPLIT_SQL + """
SELECT (e // 500)::INT AS ke, (n // 500)::INT AS kn, 250000::BIGINT AS cells, sum(h_in)::BIGINT AS inches, sum(h_in * (e % 500 * 500 + n % 500))::BIGINT AS placed, (250000 - count(*))::BIGINT AS water FROM held GROUP BY ALL"""))
def tile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as they are stored, unpacked again and added up."""
    tiles_held = raster.split_tiles(_held(spark, sf_dir))
    place = (F.col("e") % 500 * 500 + F.col("n") % 500).cast("long")
    cells = raster.tile_cells(tiles_held, tiles_held)
    return cells.groupBy("ke", "kn").agg(F.count(F.lit(1)).alias("cells"), F.sum("h_in").alias("inches"), F.sum(F.col("h_in") * place).alias("placed"), F.count_if(F.col("class") == 3).alias("water"))


@query(_with(S.BOXES_SQL, _SPLIT_SQL + " SELECT (e // 500)::INT AS ke, (n // 500)::INT AS kn, min(h_in)::INT AS lowest, max(h_in)::INT AS highest FROM held GROUP BY ALL"))
def tile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_range(_held(spark, sf_dir)).select(F.col("ke").cast("int").alias("ke"), F.col("kn").cast("int").alias("kn"), F.col("lowest").cast("int").alias("lowest"), F.col("highest").cast("int").alias("highest"))


@query(_with(S.BOXES_SQL, """
foot AS (SELECT obstruction_id AS bin, e, n, w, h FROM boxes WHERE h_in % 24 = 0)
SELECT b.obstruction_id AS bin, c.e, c.n, CASE WHEN f.bin IS NOT NULL AND c.e + 0.0 > f.e + 0.5 AND c.e + 0.0 < f.e + f.w - 0.5 AND c.n + 0.0 > f.n + 0.5 AND c.n + 0.0 < f.n + f.h - 0.5 THEN 0 ELSE c.h_in END::INT AS h_in
FROM box_cells c JOIN boxes b USING (obstruction_id) LEFT JOIN foot f ON f.bin = b.obstruction_id"""))
def footprint_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under a building's own outline, drawn half a foot inside its box, are set to 0."""
    c = F.col
    boxes = S.boxes(spark, sf_dir, by_id=True)
    inner = S.rings(boxes.where("h_in % 24 = 0").select(c("obstruction_id").alias("bin"), (c("e") + 0.5).alias("e"), (c("n") + 0.5).alias("n"), (c("w") - 1).alias("w"), (c("h") - 1).alias("h")))
    cells = raster.rasterize(S.rings(boxes), "obstruction_id", "h_in").select(c("obstruction_id").alias("bin"), "e", "n", "h_in")
    return terrain.without_footprint(cells, inner).select("bin", "e", "n", c("h_in").cast("int").alias("h_in"))


@query(f"""
SELECT (ke + {S.EAST // 500})::INT AS ke, (kn + {S.NORTH // 500})::INT AS kn FROM (SELECT DISTINCT r_regionkey * 20 AS k FROM region), LATERAL (SELECT unnest(range(k, k + 11)) AS ke), LATERAL (SELECT unnest(range(k, k + 7)) AS kn)
WHERE ke * 500 >= k * 500 + 250 AND (ke + 1) * 500 <= k * 500 + 250 + 4100 AND kn * 500 >= k * 500 + 100 AND (kn + 1) * 500 <= k * 500 + 100 + 2500""")
def city_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles wholly inside one of five outlines."""
    k = F.col("r_regionkey") * 10_000
    outlines = S.rings(S.table(spark, sf_dir, "region").select((F.lit(S.EAST + 250) + k).alias("e"), (F.lit(S.NORTH + 100) + k).alias("n"), F.lit(4100).alias("w"), F.lit(2500).alias("h")))
    return terrain.city_tiles(outlines).select(F.col("ke").cast("int").alias("ke"), F.col("kn").cast("int").alias("kn"))
_MASKED_SQL = """
roof_cells AS (SELECT obstruction_id AS bin, c.e, c.n, (h_in + CASE WHEN c.e % 8 < 4 THEN 0 ELSE 90 END)::INT AS h_in, (c.e + c.n) % 6 <> 0 AS mask, sw_e, sw_n FROM box_cells c JOIN (SELECT obstruction_id, e AS sw_e, n AS sw_n FROM boxes) USING (obstruction_id)),
on_grid AS (SELECT * FROM roof_cells WHERE (e - sw_e) % 4 = 2 AND (n - sw_n) % 4 = 2),
samples AS (
  SELECT g.bin, g.e, g.n, any_value(g.h_in) AS h_in, max(o.h_in) AS next_in FROM on_grid g
  LEFT JOIN on_grid o ON o.bin = g.bin AND abs(o.e - g.e) + abs(o.n - g.n) = 4 AND (o.e = g.e OR o.n = g.n) WHERE g.mask GROUP BY ALL
)"""


def _roof_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = S.rings(S.boxes(spark, sf_dir, by_id=True)).withColumnsRenamed({"obstruction_id": "bin", "e": "sw_e", "n": "sw_n"})
    step = F.when(F.col("e") % 8 < 4, 0).otherwise(90)
    return raster.rasterize(corners, "bin", "h_in", "sw_e", "sw_n").select("bin", "e", "n", (F.col("h_in") + step).cast("int").alias("h_in"), ((F.col("e") + F.col("n")) % 6 != 0).alias("mask"), "sw_e", "sw_n")


@query(_with(S.BOXES_SQL, _MASKED_SQL + " SELECT * FROM samples"))
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooftop.grid_samples(_roof_cells(spark, sf_dir), _SPACING)


@query(_with(S.BOXES_SQL, _MASKED_SQL + " SELECT bin, e, n, k::INT AS k, (h_in + k * 24)::INT AS z_in FROM (SELECT *, unnest(range(1, (next_in - h_in) // 24 + 2)) AS k FROM samples WHERE next_in - h_in > 48)"))
def cliff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooftop.cliff_samples(rooftop.grid_samples(_roof_cells(spark, sf_dir), _SPACING), _SPACING)


@query("""
SELECT o_orderkey, o_custkey, z, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY z DESC, o_orderkey) = 1 THEN z + 5 ELSE z END AS measure_z
FROM (SELECT o_orderkey, o_custkey, (floor(o_totalprice)::BIGINT % 40)::DOUBLE AS z FROM orders)""")
def mast_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bin"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.floor("o_totalprice").cast("long") % 40).cast("double").alias("z"), F.col("o_orderkey").alias("place")
    )
    return rooftop.mast_points(rows, 5.0).select(F.col("place").alias("o_orderkey"), F.col("bin").alias("o_custkey"), "z", "measure_z")


@query(_with(S.BOXES_SQL, _MASKED_SQL + """
SELECT s.bin, s.e, s.n FROM samples s WHERE NOT EXISTS (SELECT 1 FROM boxes b, (VALUES (0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)) k(i, j)
  WHERE b.obstruction_id = s.bin AND (s.e + 0.5 - b.e - i * w) * (s.e + 0.5 - b.e - i * w) + (s.n + 0.5 - b.n - j * h) * (s.n + 0.5 - b.n - j * h) < 16)"""))
def cull_near_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = rooftop.grid_samples(_roof_cells(spark, sf_dir), _SPACING).select("bin", "e", "n", (F.col("e") + 0.5).alias("x"), (F.col("n") + 0.5).alias("y"))
    corner = F.explode(F.array(*(F.struct((F.col("e") + i * F.col("w")).cast("double").alias("x"), (F.col("n") + j * F.col("h")).cast("double").alias("y")) for i in (0, 1) for j in (0, 1))))
    corners = S.boxes(spark, sf_dir, by_id=True).select(F.col("obstruction_id").alias("bin"), corner.alias("p")).select("bin", "p.x", "p.y")
    return rooftop.cull_near(points, corners, 4.0).select("bin", "e", "n")


@query(_with(S.BOXES_SQL, _MASKED_SQL + """
SELECT c.bin, c.e, c.n, arg_min((s.e + s.n) % 3, ((s.e - c.e) * (s.e - c.e) + (s.n - c.n) * (s.n - c.n), s.e, s.n))::INT AS status FROM roof_cells c JOIN samples s ON s.bin = c.bin GROUP BY ALL"""))
def nearest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _roof_cells(spark, sf_dir)
    found = rooftop.grid_samples(cells, _SPACING).select("bin", (F.col("e") + 0.5).alias("x"), (F.col("n") + 0.5).alias("y"), F.struct("e", "n").alias("sample_id"), ((F.col("e") + F.col("n")) % 3).cast("int").alias("status"))
    return rooftop.nearest_status(cells, found, _SPACING)


@query(
    _with(
        S.BOXES_SQL,
        _MASKED_SQL,
        """
ring AS (SELECT obstruction_id AS bin, e, n, w, h, 4 * unnest(range((2 * (w + h) + 3) // 4)) AS d FROM boxes),
walk AS (
  SELECT bin, e, n, w, h, d, (CASE WHEN d < w THEN e + d WHEN d < w + h THEN e + w WHEN d < 2 * w + h THEN e + 2 * w + h - d ELSE e END)::DOUBLE AS x,
    (CASE WHEN d < w THEN n WHEN d < w + h THEN n + d - w WHEN d < 2 * w + h THEN n + h ELSE n + 2 * w + 2 * h - d END)::DOUBLE AS y FROM ring
),
tried AS (
  SELECT bin, d, x, y, least(greatest(floor(x)::INT, e), e + w - 1) + i AS ce, least(greatest(floor(y)::INT, n), n + h - 1) + j AS cn, r
  FROM walk, (VALUES (0, 0, 0), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, -1), (5, 0, 1), (6, 1, -1), (7, 1, 0), (8, 1, 1)) t(r, i, j)
),
edge AS (SELECT t.bin, d, x, y, arg_min(h_in, r) / 12 AS z FROM tried t JOIN roof_cells c ON c.bin = t.bin AND c.e = ce AND c.n = cn WHERE mask GROUP BY ALL),
cliffs AS (SELECT bin, e, n, h_in + unnest(range(1, (next_in - h_in) // 24 + 2)) * 24 AS h_in FROM samples WHERE next_in - h_in > 48),
inner_points AS (SELECT bin, e + 0.5::DOUBLE AS x, n + 0.5::DOUBLE AS y, h_in / 12 AS z FROM (SELECT bin, e, n, h_in FROM samples UNION ALL SELECT * FROM cliffs)),
points AS (
  SELECT bin, x, y, z FROM edge UNION ALL
  SELECT bin, x, y, z FROM inner_points p WHERE NOT EXISTS (SELECT 1 FROM edge g WHERE g.bin = p.bin AND (g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y) < 4)
)
SELECT bin, x, y, z, CASE WHEN row_number() OVER (PARTITION BY bin, x, y ORDER BY z DESC) = 1 THEN z + 5 ELSE z END AS measure_z FROM points""",
    )
)
def rooftop_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = S.rings(S.boxes(spark, sf_dir, by_id=True)).select(F.col("obstruction_id").alias("bin"), "rings")
    return rooftop.rooftop_samples(polygons, _roof_cells(spark, sf_dir), 4.0, 5.0).select("bin", "x", "y", "z", "measure_z")


@query(_with(S.BOXES_SQL + " SELECT obstruction_id, e, n, (w * h)::BIGINT AS cells, 'POLYGON ((' || e || ' ' || n || ', ' || e + w || ' ' || n || ', ' || e + w || ' ' || n + h || ', ' || e || ' ' || n + h || ', ' || e || ' ' || n || '))' AS wkt FROM boxes"))
def wkt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    w, s, e, n = F.col("e"), F.col("n"), F.col("e") + F.col("w"), F.col("n") + F.col("h")
    wkt = geometry.rings_to_wkt(F.array(F.array(pair(w, s), pair(e, s), pair(e, n), pair(w, n), pair(w, s))))
    box = geometry.bounds(geometry.parse_wkt(F.col("wkt")))
    rows = S.boxes(spark, sf_dir).withColumn("wkt", wkt).withColumn("b", box)
    return rows.select("obstruction_id", F.col("b.west").cast("int").alias("e"), F.col("b.south").cast("int").alias("n"), ((F.col("b.east") - F.col("b.west")) * (F.col("b.north") - F.col("b.south"))).cast("long").alias("cells"), "wkt")
