"""The listing store's upsert: expire, match, refresh, insert, in one plan.

Store rows have row_id, id columns, first_encounted, last_encounted and sequence_broken; batch rows have batch_row_id,
the same id columns and date_scraped.  Missing id values equal missing ones.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_index, null_safe

#: Fixed value: days after which an unseen sequence is broken (at exactly this age it is).
EXPIRY_DAYS = 31
STORE = ("first_encounted", "last_encounted", "sequence_broken")


def id_columns(batch: DataFrame, row_id: str = "batch_row_id") -> list[str]:
    """Every batch column but the scrape date and the row's own id."""
    return [c for c in batch.columns if c not in ("date_scraped", row_id)]


def unbroken() -> Column:
    """Unbroken sequences; a missing flag is not one."""
    return F.coalesce(~F.col("sequence_broken"), F.lit(False))


def expire(current: DataFrame, scrape_time: datetime | Column, days: int = EXPIRY_DAYS) -> DataFrame:
    """Break the unbroken sequences last seen `days` or more before the scrape; a missing date breaks nothing."""
    at = scrape_time if isinstance(scrape_time, Column) else F.lit(scrape_time).cast(dict(current.dtypes)["last_encounted"])
    old = F.coalesce(F.col("last_encounted") <= at - F.make_dt_interval(F.lit(days)), F.lit(False))
    return current.withColumn("sequence_broken", F.when(unbroken(), old).otherwise(F.col("sequence_broken")))


def refresh(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Unbroken rows take the scrape date of the first batch row with their ids, earlier dates included.

    The batch is reduced to a row per id tuple before the join, so repeated batch rows multiply nothing.
    """
    ids = id_columns(batch)
    firsts = batch.groupBy(*ids).agg(F.min_by("date_scraped", "batch_row_id").alias("_seen"))
    firsts = firsts.select(*[F.col(c).alias(f"_b_{c}") for c in ids], "_seen")
    dated = F.col("first_encounted").isNotNull() & F.col("last_encounted").isNotNull()
    match = null_safe([F.col(c) for c in ids], [F.col(f"_b_{c}") for c in ids]) & unbroken() & dated
    return current.join(firsts, match, "left").withColumn("last_encounted", F.coalesce("_seen", "last_encounted")).select(*current.columns)


def unmatched(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows whose ids no unbroken store row has; repeats among them all stay."""
    ids = id_columns(batch)
    held = current.where(unbroken()).select(*[F.col(c).alias(f"_c_{c}") for c in ids])
    return batch.join(held, null_safe([F.col(c) for c in ids], [F.col(f"_c_{c}") for c in ids]), "left_anti")


def as_sequences(batch: DataFrame) -> DataFrame:
    """Batch rows in the store's layout: first and last seen when scraped, unbroken."""
    kept = [c for c in batch.columns if c != "date_scraped"]
    return batch.select(*kept, F.col("date_scraped").alias("first_encounted"), F.col("date_scraped").alias("last_encounted"), F.lit(False).alias("sequence_broken"))


def upsert(current: DataFrame, batch: DataFrame, scrape_time: datetime | Column, days: int = EXPIRY_DAYS) -> DataFrame:
    """The store after a scrape.  Inserted rows get row ids from the largest on, in batch order.

    Expiry comes first, so a listing seen again too late starts a new sequence.  The same batch twice changes nothing.
    """
    aged = expire(current, scrape_time, days)
    refreshed = refresh(aged, batch)
    new = dense_index(as_sequences(unmatched(aged, batch)), "batch_row_id", "_place")
    largest = current.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("_largest"))
    new = new.crossJoin(F.broadcast(largest)).withColumn("row_id", F.col("_largest") + 1 + F.col("_place"))
    return refreshed.unionByName(new.select(*current.columns))
