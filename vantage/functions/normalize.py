"""Text to typed columns: numbers, dates, lot and building numbers, boroughs, heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Borough names by number, other spellings, and placeholder building numbers.
BOROUGHS = {1: "MANHATTAN", 2: "BRONX", 3: "BROOKLYN", 4: "QUEENS", 5: "STATEN ISLAND"}
SPELLINGS = {"MN": 1, "BX": 2, "BK": 3, "QN": 4, "QS": 4, "SI": 5}
PLACEHOLDER_BINS = ["1000000", "2000000", "3000000", "4000000", "5000000"]
# Date formats, in the order in which they are tried.
DATE_FORMATS = [
    "M/d/yyyy", "yyyy-M-d", "M/d/yy h:m:s a", "M/d/yy h:m a", "M/d/yyyy H:m:s", "M/d/yyyy h:m:s a",
    "yyyy-M-d'T'H:m:s[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-M-d H:m:s", "M/d/yyyy H:m",
]


def column_name(header: str) -> str:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    out = "".join(c.lower() if c.isalnum() else " " for c in header)
    return "_".join(out.split())


def with_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(column_name(c) for c in df.columns))


def parse_number(text: Column) -> Column:
    """Dollar signs and commas dropped; null where no number is left."""
    return F.trim(F.translate(text, "$,", "")).try_cast("double")


def parse_date(text: Column) -> Column:
    """The first format that fits gives the date; a year of two digits is in this century."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(*(F.try_to_timestamp(tidy, F.lit(p)).cast("date") for p in DATE_FORMATS))


def whole_number(text: Column, highest: int) -> Column:
    """Trimmed digits up to ``highest``, else null."""
    value = F.trim(text).try_cast("decimal(20,0)")
    return F.when(F.trim(text).rlike(r"^\+?[0-9]+$") & (value <= highest), value.cast("long"))


def build_bbl(borough: Column, block: Column, lot: Column) -> Column:
    """Ten digits of borough 1..5, block (five or more) and lot (four or more); else null."""
    boro = whole_number(borough, 255)
    parts = [whole_number(F.regexp_replace(F.trim(x), ",", ""), 2**32 - 1) for x in (block, lot)]
    return F.when(boro.between(1, 5) & parts[0].isNotNull() & parts[1].isNotNull(), F.format_string("%d%05d%04d", boro, *parts))


def parse_bbl(bbl: Column) -> Column:
    """Struct of borough, block and lot; null unless there are ten characters and a leading digit."""
    text = F.trim(bbl)
    boro = F.substring(text, 1, 1)
    return F.when(
        (F.length(text) == 10) & boro.rlike("[0-9]"), F.struct(boro.cast("int").alias("borough"), F.substring(text, 2, 5).alias("block"), F.substring(text, 7, 4).alias("lot"))
    )


def borough_number(name: Column) -> Column:
    table = {v: k for k, v in BOROUGHS.items()} | SPELLINGS
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.upper(F.trim(name))]


def borough_name(number: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in BOROUGHS.items() for x in pair))[number]


def valid_bin(number: Column) -> Column:
    """Not null, empty or one of the placeholders; text on both sides."""
    return number.isNotNull() & (number != "") & ~number.isin(*PLACEHOLDER_BINS)


def is_building_id(text: Column) -> Column:
    return text.rlike(r"^[1-5][0-9]{6}\z")


def inches(feet: Column) -> Column:
    """Rounded half away from zero and held to 0..65535; null stays null (greatest alone would skip it)."""
    return F.when(feet.isNotNull(), F.least(F.greatest(F.round(feet * 12), F.lit(0.0)), F.lit(65535.0)).cast("int"))


def inches_cut(feet: Column) -> Column:
    """Cut to whole inches and held to 0..65535."""
    return F.when(feet.isNotNull(), F.floor(F.least(F.greatest(feet * 12, F.lit(0.0)), F.lit(65535.0))).cast("int"))


def fraction_byte(value: Column) -> Column:
    """0 for none, 255 for all, 1 + floor(254 v) between."""
    return F.when(value <= 0, 0).when(value >= 1, 255).otherwise((1 + F.floor(value * 254)).cast("int")).cast("smallint")
