"""Positions in a total order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Width of the key ranges that are numbered apart.
BUCKET = 1_000_000
#: Rows of the ranges that segments are cut from; larger segments have ranges of their own size.
RANGE_ROWS = 250_000
#: Ids of rows count up inside a partition below this.
IN_PARTITION = 1 << 33
#: The column that numbers segments, and how many large groups are broadcast.
SEGMENT = "_segment"
LARGE_GROUPS = 10_000


def dense_index(df: DataFrame, key: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Add the 0-based position of each row by an integer key without nulls.  Equal keys are ordered arbitrarily.

    Rows are numbered inside ranges of the key, and each range starts where the counts of those before it end: only the
    table of range counts is ordered as a whole.  A table of at most `bucket` rows is one range.  Larger ones are cut
    at sampled bounds, about `bucket` rows each however uneven the keys are, numbered where they lie, and written to
    shared storage, as the bounds must not be drawn anew.
    """
    n = df.count()
    if n <= bucket:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)).cast("long") - 1)
    ranged = written(_numbered(df, -(-n // bucket), [key], "_at"), "ranges")
    ranged = ranged.withColumns({"_range": F.floor(F.col("_at") / IN_PARTITION), "_inside": F.col("_at") % IN_PARTITION}).drop("_at")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def _numbered(df: DataFrame, ranges: int, order_by: Sequence[str], name: str) -> DataFrame:
    """df in ranges of the order columns, each sorted, with range * IN_PARTITION + place in the range as `name`."""
    return df.repartitionByRange(ranges, *order_by).sortWithinPartitions(*order_by).withColumn(name, F.monotonically_increasing_id())


def meet(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table that was aggregated by the same columns, so that a large key's rows can be split.

    An aggregate that is hashed by the join's keys is joined where it lies, and then adaptive execution cannot split a
    large partition.  A hash as a further key makes the join deal both sides anew.
    """
    mark = "_meet"
    marked = [t.withColumn(mark, F.xxhash64(*by)) for t in (df, groups)]
    return marked[0].join(marked[1], [*by, mark], how).drop(mark)


def meet_null_safe(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the other columns of groups, which has a row for each of df's values of `by`; missing equals missing."""
    other = groups.select(*[F.col(f"`{c}`").alias(f"_g_{c}") if c in by else F.col(f"`{c}`") for c in groups.columns])
    found = df.join(other, null_safe([F.col(f"`{c}`") for c in by], [F.col(f"`_g_{c}`") for c in by]))
    return found.drop(*[f"_g_{c}" for c in by])


def split_by_size(df: DataFrame, by: Sequence[str], order_by: Sequence[str], segment_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most segment_rows rows, and those of larger groups with a segment number.

    Segments are ranges of the order columns with at most segment_rows rows each, all large groups together, so no group
    has more than that in one segment however its rows lie.  They are cut from sorted ranges of at least about RANGE_ROWS
    rows: small segments do not cost a task each.  The second part is written to shared storage: its ranges
    come from a sample and must not be drawn anew.  It is None if there is no large group.
    """
    if df.count() <= segment_rows:
        return df, None
    large = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > segment_rows)
    groups, rows = large.agg(F.count("*"), F.sum("_n")).first()
    if not groups:
        return df, None
    # At most one large group for each segment_rows rows of the table; few enough are sent to the tasks.
    named = large.select(*[F.col(f"`{c}`").alias(f"_g_{c}") for c in by])
    named = F.broadcast(named) if groups <= LARGE_GROUPS else named
    same = null_safe([F.col(f"`{c}`") for c in by], [F.col(f"`_g_{c}`") for c in by])
    many = _numbered(df.join(named, same, "left_semi"), -(-rows // max(segment_rows, RANGE_ROWS)), order_by, SEGMENT)
    inside = F.col(SEGMENT) % IN_PARTITION
    many = many.withColumn(SEGMENT, F.col(SEGMENT) - inside + F.floor(inside / segment_rows))
    return df.join(named, same, "left_anti"), written(many, "segments")


def contiguous_folds(df: DataFrame, key: str, folds: int, name: str = "fold") -> DataFrame:
    """Contiguous folds in key order; the first n mod folds of them hold one row more."""
    indexed = dense_index(df, key, "_index")
    n = df.count()
    size, larger = divmod(n, folds)
    at = F.col("_index")
    if size == 0:
        fold = at
    else:
        cut = larger * (size + 1)
        fold = F.when(at < cut, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - cut) / size))
    return indexed.withColumn(name, fold.cast("int")).drop("_index")


def null_safe(left: list[Column], right: list[Column]) -> Column:
    """All pairs equal, missing equal to missing."""
    found = F.lit(True)
    for a, b in zip(left, right, strict=True):
        found = found & a.eqNullSafe(b)
    return found
