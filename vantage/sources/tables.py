"""The eight city tables from CSV exports: normalised headers, typed columns, the same rows dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.functions import normalize as N

# Public data sets by table.
SOCRATA = {
    "certificates_of_occupancy": "pkdm-hqz6", "condo_units": "p8u6-a6it", "dob_job_applications": "ic3t-wcy2",
    "dob_now_job_applications": "w9ak-ipjd", "dob_permit_issuance": "ipu4-2q9a", "dob_now_approved_permits": "rbx6-tga4",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under normalised names; quoted fields may hold line breaks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").csv(path)
    return N.with_column_names(raw)


class _Row:
    """Columns of a raw table by name; those that aren't there are empty text."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def __getitem__(self, name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in self.names else F.lit("")

    def filled(self, name: str) -> Column:
        return F.nullif(self[name], F.lit(""))


def _first_number(row: _Row, *names: str) -> Column:
    return F.coalesce(*(N.parse_number(row[n]) for n in names), F.lit(0.0))


def _text(row: _Row, *names: str) -> list[Column]:
    return [row.filled(n).alias(n) for n in names]


def _date(row: _Row, name: str) -> Column:
    return N.parse_date(row[name]).alias(name)


def building_footprints(raw: DataFrame) -> DataFrame:
    r = _Row(raw)
    return raw.select(
        *_text(r, "bin", "base_bbl", "mappluto_bbl", "geom_source", "the_geom"), _first_number(r, "height_roof", "heightroof").alias("height_roof"),
        _first_number(r, "ground_elevation", "groundelev").alias("ground_elevation"), _first_number(r, "construction_year", "cnstrct_yr").cast("int").alias("construction_year"),
        *_text(r, "last_status_type"), _date(r, "last_edited_date"),
    )


def tax_lots(raw: DataFrame) -> DataFrame:
    """Rows whose borough isn't a number up to 255 are dropped."""
    r = _Row(raw)
    boro = N.whole_number(r["boro"], 255).cast("int")
    return raw.select(
        *_text(r, "bbl"), boro.alias("boro"), N.borough_name(boro).alias("borough_name"), boro.alias("borough_number"), *_text(r, "block", "lot", "the_geom"), _date(r, "last_edited_date")
    ).where("boro IS NOT NULL")


def dob_job_applications(raw: DataFrame) -> DataFrame:
    """A lot number of ten characters is kept, any other is built from borough, block and lot."""
    r = _Row(raw)
    boro = N.borough_number(r["borough"])
    bbl = F.when(F.length(r["bbl"]) == 10, r["bbl"]).otherwise(N.build_bbl(boro.cast("string"), r["block"], r["lot"]))
    return raw.select(
        *_text(r, "bin"), bbl.alias("bbl"), *_text(r, "borough"), boro.alias("borough_number"), *_text(r, "block", "lot", "house", "street_name", "job"), F.lower(r.filled("job_type")).alias("job_type"),
        _date(r, "pre_filing_date"), _date(r, "approved"), N.parse_number(r["proposed_height"]).alias("proposed_height"), N.parse_number(r["existing_height"]).alias("existing_height"),
    )


def dob_now_job_applications(raw: DataFrame) -> DataFrame:
    r = _Row(raw)
    return raw.select(
        *_text(r, "bin", "bbl", "borough", "house_no", "street_name", "job_filing_number"), F.lower(r.filled("job_type")).alias("job_type"), _date(r, "filing_date"), _date(r, "approved_date"),
        N.parse_number(r["proposed_height"]).alias("proposed_height"),
    )


def certificates_of_occupancy(raw: DataFrame) -> DataFrame:
    """The status keeps its case."""
    r = _Row(raw)
    return raw.select(
        *_text(r, "bin", "bbl", "borough", "house_no", "street_name"), F.lower(r.filled("job_type")).alias("job_type"), _date(r, "c_of_o_issuance_date"), _date(r, "submitted_date"), *_text(r, "c_of_o_status")
    )


def dob_permit_issuance(raw: DataFrame) -> DataFrame:
    """The lot number is always built."""
    r = _Row(raw)
    boro = N.borough_number(r["borough"])
    return raw.select(
        *_text(r, "bin"), N.build_bbl(boro.cast("string"), r["block"], r["lot"]).alias("bbl"), *_text(r, "borough"), boro.alias("borough_number"), *_text(r, "block", "lot", "job"),
        F.lower(r.filled("job_type")).alias("job_type"), *_text(r, "permit_type"), _date(r, "issuance_date"), _date(r, "expiration_date"),
    )


def dob_now_approved_permits(raw: DataFrame) -> DataFrame:
    r = _Row(raw)
    return raw.select(
        *_text(r, "bin", "bbl", "borough", "job_filing_number", "work_type"), _date(r, "issued_date"), _date(r, "expired_date"), N.parse_number(r["estimated_job_costs"]).alias("estimated_job_costs")
    )


def condo_units(raw: DataFrame) -> DataFrame:
    """A borough that isn't a number is 0; the row stays."""
    r = _Row(raw)
    boro = F.coalesce(N.whole_number(r["condo_base_boro"], 255), F.lit(0)).cast("int")
    return raw.select(
        *_text(r, "condo_billing_bbl", "condo_base_bbl"), boro.alias("condo_base_boro"), *_text(r, "condo_base_block", "condo_base_lot", "condo_number"), N.borough_name(boro).alias("borough_name"), boro.alias("borough_number")
    )


TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (building_footprints, tax_lots, dob_job_applications, dob_now_job_applications, certificates_of_occupancy, dob_permit_issuance, dob_now_approved_permits, condo_units)
}


def ingest(spark: SparkSession, csv_path: str, table: str, out: str) -> None:
    """Reads one export and writes its table; the write is committed whole or not at all."""
    TABLES[table](read_csv(spark, csv_path)).write.mode("overwrite").parquet(f"{out}/{table}")


def run_sql(spark: SparkSession, text: str, folder: str) -> DataFrame:
    """Runs a query over the tables in ``folder`` and checks that it has what obstructions need."""
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)
    rows = spark.sql(text)
    missing = {"output_geometry", "ground_elevation", "height_roof", "type", "props"} - set(rows.columns)
    if missing:
        raise ValueError(f"the query has no {', '.join(sorted(missing))}")
    return rows


def check_count(df: DataFrame, expected: int) -> DataFrame:
    """Raises unless ``df`` has as many rows as its source announced."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} rows of {expected}")
    return df
