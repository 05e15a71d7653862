"""Scraped records: flattening, validity, failures, layout upgrades, summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import BUCKET
from .sequences import as_sequences

#: Names of the kinds of sale and of property, and which of them are parse failures.
SALE_TYPES = {
    "Private Treaty": True,
    "Off Plan": True,
    "Auction": True,
    "Tender": True,
    "Negotiation": True,
    "Contact Agent": True,
    "Sale Type Parsing Failed": False,
    "Parsing Failed, unable to find sale type text": False,
    "Rental": True,
    "Rental by Negotiation": True,
    "Rental Under Application": True,
    "Rental Type Parsing Failed": False,
}
PROPERTY_TYPES = ("House", "Town House", "Unit", "Serviced Apartment", "UnitBlock", "Studio", "Land", "Semi Rural", "Duplex", "Retirement Living", "Rural", "Not Specified")
#: Fixed value: columns that older stores lack.
LATER_COLUMNS = {"address_text": "string", "state": "string", "postcode": "int"}
ATTRIBUTES = ("sale_type", "details", "address_text", "state_and_postcode")

RECORD = (
    "row_id bigint, sale_type struct<name string, prices array<double>, under_contract boolean, under_application boolean, is_valid boolean>, "
    "details struct<property_type string, bedrooms int, bathrooms int, garage_spaces int, is_valid boolean>, "
    "address_text struct<string string, is_valid boolean>, state_and_postcode struct<state string, postcode int, is_valid boolean>"
)


def price_range(prices: Column) -> tuple[Column, Column]:
    """Smallest and largest price; both missing without prices."""
    return F.array_min(prices), F.array_max(prices)


def flatten(records: DataFrame) -> DataFrame:
    """Nested records as rows, in the ingest schema's column order."""
    low, high = price_range(F.col("sale_type.prices"))
    return records.select(
        "row_id", F.col("sale_type.name").alias("sale_type"), "sale_type.under_contract", "sale_type.under_application", low.alias("price_min"), high.alias("price_max"),
        "details.property_type", "details.bedrooms", "details.bathrooms", "details.garage_spaces", F.col("address_text.string").alias("address_text"), "state_and_postcode.state", "state_and_postcode.postcode",
    )


def attribute_valid(name: str) -> Column:
    return F.coalesce(F.col(f"{name}.is_valid"), F.lit(False))


def is_valid(attributes=ATTRIBUTES) -> Column:
    found = F.lit(True)
    for a in attributes:
        found = found & attribute_valid(a)
    return found


def error_type(attributes=ATTRIBUTES) -> Column:
    """Name of the first attribute that is not valid."""
    return F.coalesce(*[F.when(~attribute_valid(a), F.lit(a)) for a in attributes])


def split_valid(records: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid records, and all others."""
    return records.where(valid), records.where(~F.coalesce(valid, F.lit(False)))


def failure_log(failures: DataFrame, error: str = "error_type", row_id: str = "row_id", bucket: int = BUCKET) -> DataFrame:
    """Failures numbered from 0 by (error type, row id).

    Rows are numbered inside a type's range of row ids, and each range starts where the counts of those before it end.
    """
    ranged = failures.withColumn("_range", F.floor(F.col(row_id) / bucket))
    counts = ranged.groupBy(error, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.col(error).asc_nulls_last(), "_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(error).alias("_error"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(error, "_range").orderBy(row_id)) - 1
    numbered = ranged.withColumn("_inside", inside).join(starts, F.col(error).eqNullSafe(F.col("_error")) & (F.col("_range") == F.col("_at")))
    return numbered.withColumn("error_number", F.col("_start") + F.col("_inside")).select(*failures.columns, "error_number")


def batch_of(records: DataFrame, scraped: datetime) -> DataFrame:
    """A scrape batch with its constant date; an empty one is an error."""
    if records.isEmpty():
        raise ValueError("the batch has no records")
    return flatten(records).withColumnRenamed("row_id", "batch_row_id").withColumn("date_scraped", F.lit(scraped).cast("timestamp_ntz"))


def add_missing_columns(df: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast(t) for c, t in LATER_COLUMNS.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def upgrade_layout(df: DataFrame) -> DataFrame:
    """A store in today's layout from any of the three there have been; other tables are an error."""
    df = add_missing_columns(df)
    if {"first_encounted", "last_encounted", "sequence_broken"} <= set(df.columns):
        return df
    if "date_scraped" in df.columns:
        return as_sequences(df)
    if "datetime" in df.columns:
        return as_sequences(df.withColumnRenamed("datetime", "date_scraped"))
    raise ValueError(f"no known layout has the columns {df.columns}")


def as_text(c: Column) -> Column:
    """A value as text, 'None' where it is missing."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def price_text(prices: Column) -> Column:
    return F.concat_ws(" and ", F.transform(prices, lambda p: F.format_string("$%,.0f", p)))


def summary(sale_type: Column, property_type: Column, prices: Column, state: Column, postcode: Column) -> Column:
    """A line on a record: kind and prices, property, place; missing parts are left out."""
    return F.concat_ws(", ", sale_type, F.when(F.size(F.coalesce(prices, F.array().cast("array<double>"))) > 0, price_text(prices)), property_type, F.concat_ws(" ", state, postcode.cast("string")))


def same_record(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def checked(df: DataFrame, required: tuple[str, ...] = ("property_type", "state")) -> DataFrame:
    """The table with an error, when it is run, on any row that lacks a required value."""
    for c in required:
        df = df.where(F.assert_true(F.col(c).isNotNull(), F.lit(f"{c} is missing")).isNull())
    return df


def full_extend(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns side by side by row id, outer; of equal names the left one stays."""
    fresh = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(key, *fresh), key, "full_outer")


def preview(df: DataFrame, row_id: str = "row_id", n: int = 1000) -> DataFrame:
    return df.orderBy(row_id).limit(n)
