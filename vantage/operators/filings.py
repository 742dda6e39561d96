"""Proposed buildings from filings, permits and certificates: one builder for the five queries.

Tables have the columns of ``vantage.sources.tables``. ``as_of`` is a parameter: the same inputs
give the same rows on any day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.normalize import valid_bin

# Job types and the certificate status that count as new buildings.
NEW_BIS, NEW_NOW = ["nb"], ["new building", "alt-co - new building with existing elements to remain"]
NEW_CERTIFICATE, ISSUED = ["new building", "co - new building with existing elements to remain"], "CO Issued"


def one_per_key(df: DataFrame, keys: list[str], date: str, tie: str, latest: bool = True) -> DataFrame:
    """The latest (null dates last) or earliest (null dates first) row of each key; ties go to the smaller ``tie``."""
    order = F.desc_nulls_last(date) if latest else F.asc_nulls_first(date)
    best = Window.partitionBy(*keys).orderBy(order, F.asc(tie))
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def within_a_year(date: Column, as_of: str) -> Column:
    return date >= F.add_months(F.lit(as_of).cast("date"), -12)


def _jobs(bis: DataFrame, now: DataFrame) -> DataFrame:
    """Filings of both systems in one shape."""
    shared = ["bin", "bbl", "borough"]
    first = bis.select(
        F.col("job").alias("job_id"), *shared, F.col("house").alias("house_no"), "street_name", "job_type", F.col("pre_filing_date").alias("job_date"),
        F.col("approved").alias("approved_date"), "proposed_height", F.lit("DOB_BIS").alias("application_system"),
    )
    second = now.select(
        F.col("job_filing_number").alias("job_id"), *shared, "house_no", "street_name", "job_type", F.col("filing_date").alias("job_date"),
        "approved_date", "proposed_height", F.lit("DOB_NOW").alias("application_system"),
    )
    return first.unionByName(second)


def new_jobs(bis: DataFrame, now: DataFrame) -> DataFrame:
    jobs = _jobs(bis, now)
    kinds = F.when(F.col("application_system") == "DOB_BIS", F.col("job_type").isin(*NEW_BIS)).otherwise(F.col("job_type").isin(*NEW_NOW))
    return jobs.where(kinds & valid_bin(F.col("bin")))


def active_permit_jobs(issuance: DataFrame, approved: DataFrame, as_of: str) -> DataFrame:
    """Distinct ids of jobs with a permit that hasn't expired a year before ``as_of``."""
    first = issuance.where(F.col("issuance_date").isNotNull() & within_a_year(F.col("expiration_date"), as_of) & valid_bin(F.col("bin")) & F.col("job_type").isin(*NEW_BIS))
    second = approved.where(F.col("issued_date").isNotNull() & within_a_year(F.col("expired_date"), as_of) & valid_bin(F.col("bin")))
    return first.select(F.col("job").alias("job_id")).union(second.select(F.col("job_filing_number").alias("job_id"))).distinct()


def tax_lot_of(df: DataFrame, condo_units: DataFrame) -> DataFrame:
    """Adds tax_lot_bbl: the base lot of a condominium's billing lot, else the lot itself; repeats multiply rows."""
    base = condo_units.select(F.col("condo_billing_bbl").alias("_billing"), F.col("condo_base_bbl").alias("_base"))
    return df.join(base, F.col("bbl") == F.col("_billing"), "left").withColumn("tax_lot_bbl", F.coalesce("_base", "bbl")).drop("_billing", "_base")


def latest_heights(bis: DataFrame, now: DataFrame, needed: DataFrame) -> DataFrame:
    """bin and its latest proposed height that isn't null or zero, of the buildings in ``needed``."""
    heights = _jobs(bis, now).where(F.col("proposed_height").isNotNull() & (F.col("proposed_height") != 0))
    wanted = heights.join(needed.select("bin").distinct(), "bin", "left_semi")
    return one_per_key(wanted.select("bin", "proposed_height", "job_date", "job_id"), ["bin"], "job_date", "job_id").select("bin", F.col("proposed_height").alias("height_roof"))


@dataclass(frozen=True)
class Tables:
    bis: DataFrame
    now: DataFrame
    issuance: DataFrame
    approved: DataFrame
    certificates: DataFrame
    condo_units: DataFrame
    tax_lots: DataFrame
    footprints: DataFrame


def props(**fields: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def _resolved(one: DataFrame, t: Tables, kind: str, height_required: bool, extra: dict[str, str]) -> DataFrame:
    lots = t.tax_lots.where(F.col("the_geom").isNotNull()).select(F.col("bbl").alias("tax_lot_bbl"), F.col("the_geom").alias("output_geometry"))
    placed = tax_lot_of(one, t.condo_units).join(lots, "tax_lot_bbl")
    out = placed.join(latest_heights(t.bis, t.now, one), "bin", "left")
    if height_required:
        out = out.where(F.col("height_roof").isNotNull())
    nothing = F.lit(None).cast("double")
    fields = {"bin": F.col("bin"), "bbl": F.col("tax_lot_bbl"), "ground_elevation": nothing, "height_roof": F.col("height_roof")}
    fields |= {"street_addr": F.concat_ws("", "house_no", F.lit(" "), "street_name"), "borough": F.col("borough")} | {k: F.col(c) for k, c in extra.items()}
    return out.select("bin", "tax_lot_bbl", "output_geometry", nothing.alias("ground_elevation"), "height_roof", F.lit(kind).alias("type"), props(**fields).alias("props"))


_JOB = {"job_application_system": "application_system", "job_id": "job_id"}


def active_permits(t: Tables, as_of: str) -> DataFrame:
    """New buildings whose job has an active permit: one job for each building, the latest."""
    jobs = new_jobs(t.bis, t.now).join(active_permit_jobs(t.issuance, t.approved, as_of), "job_id")
    return _resolved(one_per_key(jobs, ["bin"], "job_date", "job_id"), t, "active_permits", False, _JOB)


def recent_job_applications(t: Tables, as_of: str) -> DataFrame:
    jobs = new_jobs(t.bis, t.now).where(within_a_year(F.col("job_date"), as_of))
    return _resolved(one_per_key(jobs, ["bin"], "job_date", "job_id"), t, "recent_job_applications", False, _JOB)


def approved_job_applications(t: Tables, as_of: str) -> DataFrame:
    jobs = new_jobs(t.bis, t.now).where(within_a_year(F.col("approved_date"), as_of))
    return _resolved(one_per_key(jobs, ["bin"], "approved_date", "job_id"), t, "approved_job_applications", False, _JOB)


def new_construction_certificates(t: Tables, after: str = "2021-05-01") -> DataFrame:
    """Buildings by their first new-building certificate after a date; a height is required."""
    issued = t.certificates.where(F.col("job_type").isin(*NEW_CERTIFICATE) & (F.col("c_of_o_status") == ISSUED) & (F.col("c_of_o_issuance_date") > F.lit(after).cast("date")))
    first = one_per_key(issued, ["bin"], "c_of_o_issuance_date", "bbl", latest=False)
    return _resolved(first, t, "new_construction_co", True, {"tco_date": "c_of_o_issuance_date"})


def new_construction_footprints(t: Tables, since: int = 2021) -> DataFrame:
    rows = t.footprints.where((F.col("construction_year") >= since) & F.col("height_roof").isNotNull() & F.col("the_geom").isNotNull())
    fields = {"bin": "bin", "bbl": "base_bbl", "ground_elevation": "ground_elevation", "height_roof": "height_roof", "geom_source": "geom_source"}
    kept = {k: F.col(c) for k, c in fields.items()} | {"construction_year": F.col("construction_year").cast("int"), "last_status_type": F.col("last_status_type")}
    return rows.select(
        "bin", F.col("base_bbl").alias("tax_lot_bbl"), F.col("the_geom").alias("output_geometry"), "ground_elevation", "height_roof",
        F.lit("new_construction_footprints").alias("type"), props(**kept).alias("props"),
    )
