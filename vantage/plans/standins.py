"""The test tables in the roles of the system's own: the same integer arithmetic here and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators.filings import Tables
from vantage.sources.splits import dealt, dealt_by

AS_OF, AFTER, EAST, NORTH = "2001-08-02", "1998-01-01", 1_000_000, 235_000
#: Rows that one task takes: a box becomes about 200 cells, a link about 350.
BOXES, LINKS = 4_000, 2_500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def filings(spark: SparkSession, sf_dir: str) -> Tables:
    """orders as filings and certificates, lineitem as permits, supplier as condominiums, nation as lots, part as footprints."""
    c = F.col
    orders = table(spark, sf_dir, "orders").select(
        _text(c("o_orderkey")).alias("job"), _text(c("o_custkey") + 1_000_000).alias("bin"), _text(c("o_custkey") % 100).alias("bbl"), c("o_orderpriority").alias("borough"),
        _text(c("o_orderkey") % 1000).alias("house"), c("o_orderpriority").alias("street_name"), c("o_orderdate").cast("date").alias("day"), c("o_orderstatus").alias("status"),
        F.when(c("o_orderkey") % 3 == 0, "nb").otherwise("a1").alias("kind"), (F.floor(c("o_totalprice")).cast("long") % 50).cast("double").alias("proposed_height"),
    )
    new = F.when(c("kind") == "nb", "new building").otherwise("a1")
    approved = F.date_add("day", 30)
    bis = orders.where("status = 'F'").select("job", "bin", "bbl", "borough", "house", "street_name", c("kind").alias("job_type"), c("day").alias("pre_filing_date"), approved.alias("approved"), "proposed_height")
    now = orders.where("status <> 'F'").select(
        c("job").alias("job_filing_number"), "bin", "bbl", "borough", c("house").alias("house_no"), "street_name", new.alias("job_type"), c("day").alias("filing_date"), approved.alias("approved_date"), "proposed_height"
    )
    items = table(spark, sf_dir, "lineitem").select(_text(c("l_orderkey")).alias("job"), _text(c("l_partkey") + 1_000_000).alias("bin"), c("l_shipdate").cast("date").alias("day"), c("l_returnflag").alias("flag"))
    issuance = items.where("flag = 'R'").select("job", "bin", F.lit("nb").alias("job_type"), c("day").alias("issuance_date"), F.date_add("day", 200).alias("expiration_date"))
    permits = items.where("flag <> 'R'").select(c("job").alias("job_filing_number"), "bin", c("day").alias("issued_date"), F.date_add("day", 100).alias("expired_date"))
    certificates = orders.select(
        "bin", "bbl", "borough", c("house").alias("house_no"), "street_name", new.alias("job_type"), c("day").alias("c_of_o_issuance_date"),
        F.when(c("status") == "P", "Filed").otherwise("CO Issued").alias("c_of_o_status"),
    )
    condos = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(_text(c("s_suppkey")).alias("condo_billing_bbl"), _text(c("s_nationkey")).alias("condo_base_bbl"))
    lots = table(spark, sf_dir, "nation").select(_text(c("n_nationkey")).alias("bbl"), F.when(c("n_nationkey") % 7 != 0, F.concat(F.lit("POLYGON (("), c("n_name"), F.lit("))"))).alias("the_geom"))
    footprints = table(spark, sf_dir, "part").select(
        _text(c("p_partkey") + 1_000_000).alias("bin"), _text(c("p_partkey") % 100).alias("base_bbl"), F.when(c("p_partkey") % 9 != 0, c("p_name")).alias("the_geom"), c("p_size").cast("double").alias("ground_elevation"),
        F.floor("p_retailprice").cast("double").alias("height_roof"), (c("p_size") + 1990).cast("double").alias("construction_year"), c("p_type").alias("last_status_type"), c("p_brand").alias("geom_source"),
    )
    return Tables(bis, now, issuance, permits, certificates, condos, lots, footprints)


FILINGS_SQL = f"""
filed AS (
  SELECT o_orderkey::VARCHAR AS job, (o_custkey + 1000000)::VARCHAR AS bin, (o_custkey % 100)::VARCHAR AS bbl, o_orderpriority AS borough, (o_orderkey % 1000)::VARCHAR AS house,
    o_orderdate::DATE AS day, o_orderdate::DATE + 30 AS approved, o_orderstatus AS status, o_orderkey % 3 = 0 AS fresh, (floor(o_totalprice)::BIGINT % 50)::DOUBLE AS height,
    CASE WHEN o_orderstatus = 'F' THEN 'DOB_BIS' ELSE 'DOB_NOW' END AS system
  FROM orders
),
fresh AS (SELECT * FROM filed WHERE fresh AND bin NOT IN ('1000000', '2000000', '3000000', '4000000', '5000000')),
lots AS (SELECT n_nationkey::VARCHAR AS lot, 'POLYGON ((' || n_name || '))' AS geom FROM nation WHERE n_nationkey % 7 <> 0),
condos AS (SELECT s_suppkey::VARCHAR AS billing, s_nationkey::VARCHAR AS base FROM supplier WHERE s_suppkey % 4 <> 0),
tall AS (
  SELECT bin, height FROM filed WHERE height <> 0 QUALIFY row_number() OVER (PARTITION BY bin ORDER BY day DESC, job) = 1
)"""


def points(spark: SparkSession, sf_dir: str, side: int = 100) -> DataFrame:
    """lineitem as points on a square of ``side`` feet."""
    kind = F.when(F.col("l_returnflag") == "R", 7).when(F.col("l_returnflag") == "A", 3).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        (F.lit(EAST) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % side).cast("double").alias("x"), (F.lit(NORTH) + (F.col("l_partkey") * 11) % side).cast("double").alias("y"),
        F.col("l_quantity").alias("z"), kind.alias("class"),
    )


def points_sql(side: int = 100) -> str:
    return f"""
points AS (
  SELECT ({EAST} + (l_orderkey * 7 + l_linenumber * 13) % {side})::INT AS e, ({NORTH} + (l_partkey * 11) % {side})::INT AS n, l_quantity AS z,
    CASE l_returnflag WHEN 'R' THEN 7 WHEN 'A' THEN 3 ELSE 2 END AS class FROM lineitem
),
raster AS (
  SELECT e, n, greatest(max(z), 0.0) AS height, count(*) AS points, greatest(coalesce(max(CASE WHEN class = 3 THEN z END), 0.0), 0.0) AS veg FROM points WHERE class NOT IN (7, 18) AND z < 2000 GROUP BY ALL
)"""


def boxes(spark: SparkSession, sf_dir: str, by_id: bool = False) -> DataFrame:
    """part as boxes of whole cells with a height, dealt out by place or (``by_id``) by obstruction_id."""
    c = F.col
    held = table(spark, sf_dir, "part").select(
        _text(c("p_partkey")).alias("obstruction_id"), c("p_brand").alias("obstruction_type"), (F.lit(EAST) + c("p_partkey") * 37 % 2400).cast("int").alias("e"), (F.lit(NORTH) + c("p_partkey") * 53 % 2400).cast("int").alias("n"),
        (5 + c("p_size") % 20).cast("int").alias("w"), (5 + c("p_partkey") % 20).cast("int").alias("h"), (c("p_size") * 12).cast("int").alias("h_in"),
    )
    return dealt_by(held, BOXES, "obstruction_id") if by_id else dealt(held, BOXES, "e", "n", "obstruction_id")


BOXES_SQL = f"""
boxes AS (
  SELECT p_partkey::VARCHAR AS obstruction_id, p_brand AS obstruction_type, ({EAST} + p_partkey * 37 % 2400)::INT AS e, ({NORTH} + p_partkey * 53 % 2400)::INT AS n,
    (5 + p_size % 20)::INT AS w, (5 + p_partkey % 20)::INT AS h, (p_size * 12)::INT AS h_in FROM part
),
box_cells AS (
  SELECT obstruction_id, w, h, h_in, (e + i)::INT AS e, (n + j)::INT AS n FROM (SELECT *, unnest(range(w)) AS i FROM boxes), LATERAL (SELECT unnest(range(h)) AS j)
)"""


def rings(df: DataFrame) -> DataFrame:
    """Boxes with their outline as rings."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, s, e, n = F.col("e"), F.col("n"), F.col("e") + F.col("w"), F.col("n") + F.col("h")
    return df.withColumn("rings", F.array(F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as links of 50 to 300 feet at 60 GHz, near the ground."""
    k = F.col("c_custkey")
    ae, an, az = (F.lit(EAST) + k * 17 % 2000).cast("double"), (F.lit(NORTH) + k * 29 % 2000).cast("double"), (5 + k % 40).cast("double")
    held = table(spark, sf_dir, "customer").select(
        k.alias("link_id"), ae.alias("ae"), an.alias("an"), az.alias("az"), (ae + 40 + k % 200).alias("be"), (an + 30 + k % 150).alias("bn"), (az + k % 20).alias("bz"), F.lit(60e9).alias("hertz")
    )
    return dealt(held, LINKS, "ae", "an", "link_id")


LINKS_SQL = f"""
links AS (
  SELECT link_id, ae, an, az, ae + 40 + link_id % 200 AS be, an + 30 + link_id % 150 AS bn, az + link_id % 20 AS bz, 60e9::DOUBLE AS hertz
  FROM (SELECT c_custkey AS link_id, ({EAST} + c_custkey * 17 % 2000)::DOUBLE AS ae, ({NORTH} + c_custkey * 29 % 2000)::DOUBLE AS an, (5 + c_custkey % 40)::DOUBLE AS az FROM customer)
),
deltas AS (SELECT *, be - ae AS de, bn - an AS dn, bz - az AS dz, 299792458.0::DOUBLE / hertz * (1.0::DOUBLE / 0.3048006096::DOUBLE) AS wave FROM links, (VALUES (1.0::DOUBLE), (0.6::DOUBLE)) alphas(alpha)),
axes AS (
  SELECT *, (dist + wave / 2) / 2 AS major, sqrt(wave * dist) / 2 * alpha AS minor, de / dist AS ue, dn / dist AS un, dz / dist AS uz, sqrt(de * de + dn * dn) AS flat, (ae + be) / 2 AS me, (an + bn) / 2 AS mn, (az + bz) / 2 AS mz
  FROM (SELECT *, sqrt(de * de + dn * dn + dz * dz) AS dist FROM deltas)
),
forms AS (
  SELECT *, tail * ue * ue + ball AS m00, tail * ue * un AS m01, tail * ue * uz AS m02, tail * un * un + ball AS m11, tail * un * uz AS m12, tail * uz * uz + ball AS m22,
    sqrt(minor * minor * (1.0::DOUBLE - un * un) + major * major * (un * un)) AS reach
  FROM (SELECT *, 1.0::DOUBLE / (minor * minor) AS ball, 1.0::DOUBLE / (major * major) - 1.0::DOUBLE / (minor * minor) AS tail FROM axes)
),
slices AS (SELECT *, n - mn AS dy FROM (SELECT *, unnest(range(ceil(mn - reach)::BIGINT, floor(mn + reach)::BIGINT + 1)) AS n FROM forms)),
solved AS (SELECT *, m01 * dy AS p, m12 * dy AS q, m11 * dy * dy - 1.0::DOUBLE AS f, m00 * m22 - m02 * m02 AS det FROM slices),
centred AS (SELECT *, -(m22 * p - m02 * q) / det AS u, -(m00 * q - m02 * p) / det AS v FROM solved),
sized AS (SELECT *, sqrt(-(m22 * fn) / det) AS hw FROM (SELECT *, f + p * u + q * v AS fn FROM centred) WHERE fn <= 0),
zone_rows AS (SELECT * FROM (SELECT *, ceil(me + u - hw)::BIGINT AS e_lo, floor(me + u + hw)::BIGINT AS e_hi FROM sized) WHERE e_hi >= e_lo),
zone_parts AS (
  SELECT *, e - (me + u) AS x, ((e - me) * de + dy * dn) / flat AS axial, 6369160.0::DOUBLE * (1.0::DOUBLE / 0.3048006096::DOUBLE) AS r FROM (SELECT *, unnest(range(e_lo, e_hi + 1)) AS e FROM zone_rows)
),
zone_heights AS (
  SELECT *, sqrt(greatest((m02 * m02 - m00 * m22) / (m22 * m22) * x * x - fn / m22, 0.0)) AS span, -(m02 / m22) * x + v + mz AS centre, sqrt(greatest(r * r - axial * axial, 0.0)) - sqrt(r * r - major * major) AS sag FROM zone_parts
),
zone_cells AS (
  SELECT link_id, alpha, n::INT AS n, e::INT AS e, floor(least(greatest((centre - span - sag) * 12, 0.0), 65535.0))::INT AS bottom, floor(least(greatest((centre + span - sag) * 12, 0.0), 65535.0))::INT AS top,
    e_lo::INT AS west, ae, an, be, bn FROM zone_heights
)"""

TERRAIN_SQL = """
terrain AS (SELECT e, n, max(h_in)::INT AS h_in FROM (SELECT e, n, h_in FROM box_cells UNION ALL SELECT e, n, (height * 12)::INT FROM raster) GROUP BY ALL)"""

FRACTION_SQL = """
hits AS (
  SELECT z.*, CASE WHEN (west - ae) * (west - ae) + (z.n - an) * (z.n - an) <= 36 OR (west - be) * (west - be) + (z.n - bn) * (z.n - bn) <= 36 THEN 0
    WHEN coalesce(h_in, 0) >= top THEN 255 WHEN coalesce(h_in, 0) <= bottom THEN 0
    ELSE (1 + floor((coalesce(h_in, 0) - bottom) / (top - bottom) * 254))::INT END AS fraction
  FROM zone_cells z LEFT JOIN terrain t ON t.e = z.e AND t.n = z.n
),
verdicts AS (
  SELECT link_id, max(CASE WHEN alpha = 1.0 THEN fraction END) AS max_full, coalesce(max(CASE WHEN alpha = 0.6 THEN fraction END), 0) AS max_inner FROM hits GROUP BY link_id
),
results AS (
  SELECT link_id, max_full::INT AS max_full, max_inner::INT AS max_inner, CASE WHEN max_full = 0 THEN 'Unobstructed' WHEN max_inner = 0 THEN 'PartiallyObstructed' ELSE 'Obstructed' END AS result FROM verdicts WHERE max_full IS NOT NULL
)"""

COMPONENT_SQL = "(({0} // 2500) // 4 * 10 + [0, 2, 5, 7][({0} // 2500) % 4 + 1])"


def tile_sql(e: str, n: str) -> str:
    """SQL of the name of the tile that holds a cell."""
    ce, cn = COMPONENT_SQL.format(f"({e})"), COMPONENT_SQL.format(f"({n})")
    short = f"(CASE WHEN {ce} >= 1000 THEN {ce} - 1000 ELSE {ce} END)"
    return f"(CASE WHEN {short} = 0 THEN {cn}::VARCHAR ELSE {short}::VARCHAR || lpad({cn}::VARCHAR, 3, '0') END || '_' || (({e}) // 500 % 5)::VARCHAR || (({n}) // 500 % 5)::VARCHAR)"
