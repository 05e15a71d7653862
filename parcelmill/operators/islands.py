"""Gaps and islands over listings: ids, merging, and the checks on a store.

An island is a run of one property's listings, in order of first and last sight, without a gap of more than MAX_GAP
between a listing's first sight and the last sight of the one just before it.  Islands are numbered inside a property.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import SEGMENT, meet_null_safe, null_safe, split_by_size

#: The largest gap inside an island, 365 / 6 days, and the columns that do not tell properties apart.
MAX_GAP_SECONDS = 5_256_000
#: Rows of a property from which on it is cut into segments of about so many rows.
SEGMENT_ROWS = 1_000_000
OTHER_COLUMNS = ("price_min", "price_max", "sequence_broken", "first_encounted", "last_encounted")


class ListingRuleError(ValueError):
    """Listings that break a rule: its name, how many rows do, and some of them."""

    def __init__(self, rule: str, count: int, examples: Sequence = ()):
        super().__init__(f"{rule}: {count} listings{', such as ' + str(list(examples)) if examples else ''}")
        self.rule, self.count, self.examples = rule, count, list(examples)


def property_columns(df: DataFrame, row_id: str = "row_id") -> list[str]:
    """Names of the columns that tell properties apart, in name order."""
    return sorted(c for c in df.columns if c not in OTHER_COLUMNS and c != row_id)


def _any_missing(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def island_ids(
    df: DataFrame, props: Sequence[str], first: str = "first_encounted", last: str = "last_encounted", order_by: Sequence[str] = ("first_encounted", "last_encounted", "row_id"),
    gap_seconds: int = MAX_GAP_SECONDS, null_safe: bool = False, running_max: bool = False, name: str = "island", segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add the island number, from 1 inside each property.

    A row with a missing property value is an island of its own unless null_safe.  running_max compares with the latest
    sight among all earlier rows (the older rule) rather than the row just before.

    A property with at most segment_rows rows is one window.  Larger ones are cut into segments in their order, each a
    window of its own; what a segment needs to know of those before it, the last sight and how many islands have begun,
    is carried over a table with a row for each segment.
    """

    def starts(before: Column) -> Column:
        apart = F.coalesce(F.col(first) > before + F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)")), F.lit(False))
        found = before.isNull() | apart
        return (found if null_safe else found | _any_missing(props)).cast("int")

    def whole(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*props).orderBy(*order_by)
        before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)) if running_max else F.lag(last).over(order)
        return rows.withColumn("_starts", starts(before)).withColumn(name, F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")

    def scanned(rows: DataFrame) -> DataFrame:
        inside, across = Window.partitionBy(*props, SEGMENT).orderBy(*order_by), Window.partitionBy(*props).orderBy(SEGMENT)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        if running_max:
            own, end, carry = F.max(last).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.max(last), F.max("_end").over(earlier)
        else:
            own, end, carry = F.lag(last).over(inside), F.max_by(last, F.struct(*order_by)), F.lag("_end").over(across)
        ends = rows.groupBy(*props, SEGMENT).agg(end.alias("_end")).withColumn("_carry", carry).drop("_end")
        rows = meet_null_safe(rows.withColumn("_own", own).withColumn("_opens", F.row_number().over(inside) == 1), ends, [*props, SEGMENT])
        before = F.greatest("_own", "_carry") if running_max else F.when(F.col("_opens"), F.col("_carry")).otherwise(F.col("_own"))
        rows = rows.withColumn("_starts", starts(before))
        begun = rows.groupBy(*props, SEGMENT).agg(F.sum("_starts").alias("_n")).withColumn("_begun", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        rows = meet_null_safe(rows, begun, [*props, SEGMENT])
        count = F.col("_begun") + F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(name, count).select(*df.columns, name)

    few, many = split_by_size(df, props, order_by, segment_rows)
    return whole(few) if many is None else whole(few).unionByName(scanned(many))


def merge_islands(df: DataFrame, props: Sequence[str], island: str = "island", row_id: str = "row_id") -> DataFrame:
    """One row per island: id and first sight of the earliest row, and last sight, flag and prices of the latest.

    Of equally late rows the later in (first, row id) order counts.
    """
    late = F.max_by(F.struct("last_encounted", "sequence_broken", "price_min", "price_max"), F.struct("last_encounted", "first_encounted", row_id))
    merged = df.groupBy(*props, island).agg(F.min_by(row_id, F.struct("first_encounted", "last_encounted", row_id)).alias(row_id), F.min("first_encounted").alias("first_encounted"), late.alias("_late"))
    return merged.select(row_id, *props, "first_encounted", "_late.*")


def unduplicate(df: DataFrame, null_safe: bool = False) -> DataFrame:
    props = property_columns(df)
    return merge_islands(island_ids(df, props, null_safe=null_safe), props).select(*df.columns)


def check_and_unduplicate(df: DataFrame, ordered: bool = False, unbroken: bool = False, parallel: bool = False) -> DataFrame:
    """Run the checks, then merge each property's islands.

    Dates are always checked.  The windows sort each property's listings themselves, so their order as stored, in which
    a store may be partial, is checked on request, as are unbroken listings and listings that run side by side.
    """
    check_dates(df)
    if ordered:
        check_order(df)
    if unbroken:
        check_unbroken(df)
    if parallel:
        check_parallel(df)
    return unduplicate(df)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group of equal values, missing ones equal and first, in the given total order."""
    return _kept(df, by, F.min_by(F.struct(*df.columns), F.struct(*order)))


def keep_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _kept(df, by, F.max_by(F.struct(*df.columns), F.struct(*order)))


def _kept(df: DataFrame, by: Sequence[str], row: Column) -> DataFrame:
    """One aggregate, combined map-side: a large group is never sorted in one task."""
    return df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(row.alias("_row")).select("_row.*")


def duplicate_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """All rows of groups with more than one, missing values equal, with the group's size as n.

    Sizes are counted map-side first and joined back, so one large group never sits in one task.
    """
    sizes = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(sizes, null_safe([F.col(c) for c in by], [F.col(f"_g_{c}") for c in by])).select(*df.columns, "n")


def unordered_listings(df: DataFrame, props: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Rows seen first after the next row of their property, or with it and last after it, in row id order."""
    order = Window.partitionBy(*props).orderBy(row_id)
    next_first, next_last = F.lead("first_encounted").over(order), F.lead("last_encounted").over(order)
    late = (F.col("first_encounted") > next_first) | ((F.col("first_encounted") == next_first) & (F.col("last_encounted") > next_last))
    return df.withColumn("_late", F.coalesce(late, F.lit(False)) & ~_any_missing(props)).where("_late").drop("_late")


def check_order(df: DataFrame) -> None:
    bad = unordered_listings(df, property_columns(df))
    n = bad.count()
    if n:
        raise ListingRuleError("stored out of order", n, bad.limit(3).collect())


def parallel_listings(df: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows first seen before another listing of their property, seen earlier, was last seen.

    The latest sight of large properties is carried from segment to segment, as for island_ids.
    """
    props, order_by = property_columns(df), ("first_encounted", "last_encounted", "row_id")

    def beside(rows: DataFrame, latest: Column) -> DataFrame:
        found = F.coalesce(F.col("first_encounted") < latest, F.lit(False))
        return rows.withColumn("_beside", found & ~_any_missing(props)).where("_beside").select(*df.columns)

    def latest(*by: str) -> Column:
        return F.max("last_encounted").over(Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1))

    few, many = split_by_size(df, props, order_by, segment_rows)
    found = beside(few, latest(*props))
    if many is not None:
        earlier = Window.partitionBy(*props).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        ends = many.groupBy(*props, SEGMENT).agg(F.max("last_encounted").alias("_end")).withColumn("_carry", F.max("_end").over(earlier)).drop("_end")
        rows = meet_null_safe(many.withColumn("_own", latest(*props, SEGMENT)), ends, [*props, SEGMENT])
        found = found.unionByName(beside(rows, F.greatest("_own", "_carry")))
    return found


def check_parallel(df: DataFrame) -> None:
    n = parallel_listings(df).count()
    if n:
        raise ListingRuleError("side by side with another of the property", n)


def check_dates(df: DataFrame) -> None:
    n = df.where("first_encounted > last_encounted").count()
    if n:
        raise ListingRuleError("last seen before first seen", n)


def stale_unbroken(df: DataFrame) -> DataFrame:
    """Unbroken rows not seen at the latest date any unbroken row was seen."""
    open_rows = df.where(F.coalesce(~F.col("sequence_broken"), F.lit(False)))
    latest = open_rows.agg(F.max("last_encounted").alias("_latest"))
    return open_rows.crossJoin(F.broadcast(latest)).where("last_encounted < _latest").drop("_latest")


def check_unbroken(df: DataFrame) -> None:
    """Unbroken rows must all have been last seen at one date."""
    n = df.where(F.coalesce(~F.col("sequence_broken"), F.lit(False))).agg(F.countDistinct("last_encounted")).first()[0]
    if n != 1:
        raise ListingRuleError(f"unbroken at {n} dates", stale_unbroken(df).count())
