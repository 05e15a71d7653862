"""Predicates over listings, as columns: null results are false in a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import meet

#: Price ranges (open at both ends), kinds of sale, largest separate count.
SALES_PRICES = (2e4, 1e7)
RENTAL_PRICES = (2e1, 1e4)
SALE_KINDS = ("Private Treaty", "Maybe Private Treaty")
RENTAL_KINDS = ("Rental",)
COUNT_CAP = 8


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def sale_kind() -> Column:
    return F.col("sale_type").isin(*SALE_KINDS)


def rental_kind() -> Column:
    return F.col("sale_type").isin(*RENTAL_KINDS)


def some_price() -> Column:
    return finite(F.col("price_min")) | finite(F.col("price_max"))


def complete() -> Column:
    """The strict form: a price, a suburb and all three counts."""
    counts = F.lit(True)
    for c in ("bedrooms", "bathrooms", "garage_spaces"):
        counts = counts & finite(F.col(c).cast("double"))
    return some_price() & F.col("suburb").isNotNull() & counts


def price_in(limits: tuple[float, float], *columns: str) -> Column:
    """Every column strictly inside the limits."""
    found = F.lit(True)
    for c in columns or ("price_min", "price_max"):
        found = found & (F.col(c) > limits[0]) & (F.col(c) < limits[1])
    return found


def general_qc() -> Column:
    return F.lit(True)


def rejected(accepted: Column) -> Column:
    """The complement of a filter: rows for which it is false or unknown."""
    return ~F.coalesce(accepted, F.lit(False))


def min_population(df: DataFrame, by: str, least: int) -> DataFrame:
    """Rows whose group has at least `least` rows; a missing group has none.

    Groups are counted map-side first and met in a semi join whose large keys can be split.
    """
    large = df.groupBy(by).agg(F.count(by).alias("_n")).where(F.col("_n") >= least).select(by)
    return meet(df, large, [by], "left_semi")


def min_population_report(df: DataFrame, by: str, least: int) -> DataFrame:
    """Rows and distinct groups (a missing one counts) before and after min_population, in one row."""

    def of(frame, suffix):
        values = F.countDistinct(by) + F.coalesce(F.max(F.col(by).isNull().cast("int")), F.lit(0))
        return frame.agg(F.count("*").alias(f"rows_{suffix}"), values.alias(f"groups_{suffix}"))

    return of(df, "before").crossJoin(of(min_population(df, by, least), "after"))


def cap(c: Column, most) -> Column:
    """Values above the cap become the cap; missing stays missing."""
    return F.when(c > most, F.lit(most)).otherwise(c)


def clamp(c: Column, low, high) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def bucket(c: Column, most: int = COUNT_CAP) -> Column:
    """Groups of a count: 1 to most - 1 apart, and most or more."""
    return F.when(c >= most, F.lit(most)).when(c >= 1, c)


def in_category(column: str, *values: str) -> Column:
    """Rows of the given categories."""
    return F.col(column).isin(*values)
