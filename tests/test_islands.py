from datetime import datetime, timedelta

import pytest

from parcelmill.operators import islands

SCHEMA = "row_id long, a string, price_min int, price_max int, first_encounted timestamp_ntz, last_encounted timestamp_ntz, sequence_broken boolean"
T0 = datetime(2017, 1, 1)
GAP = timedelta(seconds=islands.MAX_GAP_SECONDS)


def listing(i, a, first, last, price=1, broken=True):
    return (i, a, price, price, first, last, broken)


def ids(df, **more):
    return {r["row_id"]: r["island"] for r in islands.island_ids(df, islands.property_columns(df), **more).collect()}


def test_gap_is_strict(spark):
    df = spark.createDataFrame([listing(0, "x", T0, T0), listing(1, "x", T0 + GAP, T0 + GAP), listing(2, "x", T0 + 2 * GAP + timedelta(seconds=1), T0 + 3 * GAP)], SCHEMA)
    assert ids(df) == {0: 1, 1: 1, 2: 2}


def test_previous_row_rule_differs_from_running_max(spark):
    df = spark.createDataFrame([listing(0, "x", T0, T0 + 9 * GAP), listing(1, "x", T0 + GAP, T0 + GAP), listing(2, "x", T0 + 3 * GAP, T0 + 3 * GAP)], SCHEMA)
    assert ids(df) == {0: 1, 1: 1, 2: 2}
    assert ids(df, running_max=True) == {0: 1, 1: 1, 2: 1}


def test_missing_property_is_alone_unless_null_safe(spark):
    df = spark.createDataFrame([listing(0, None, T0, T0), listing(1, None, T0, T0), listing(2, "x", T0, T0), listing(3, "x", T0, T0)], SCHEMA)
    assert ids(df) == {0: 1, 1: 2, 2: 1, 3: 1}
    assert ids(df, null_safe=True)[1] == 1


def test_merge_takes_latest_values_and_earliest_row(spark):
    df = spark.createDataFrame([
        listing(5, "x", T0, T0 + timedelta(1), 10), listing(3, "x", T0 + timedelta(2), T0 + timedelta(3), 20, False), listing(4, "x", T0 + 3 * GAP, T0 + 3 * GAP, 30), listing(6, "y", T0, T0, 40),
    ], SCHEMA)
    got = {r["row_id"]: (r["price_min"], r["first_encounted"], r["last_encounted"], r["sequence_broken"]) for r in islands.check_and_unduplicate(df).collect()}
    assert got == {5: (20, T0, T0 + timedelta(3), False), 4: (30, T0 + 3 * GAP, T0 + 3 * GAP, True), 6: (40, T0, T0, True)}


def test_every_row_is_in_one_island(spark):
    df = spark.createDataFrame([listing(i, "xyz"[i % 3], T0 + timedelta(31 * (i * 7 % 11)), T0 + timedelta(31 * (i * 7 % 11) + 1)) for i in range(60)], SCHEMA)
    assert sorted(ids(df)) == list(range(60))


def test_checks_raise(spark):
    swapped = spark.createDataFrame([listing(0, "x", T0 + GAP, T0)], SCHEMA)
    with pytest.raises(islands.ListingRuleError, match="before first seen"):
        islands.check_dates(swapped)
    unordered = spark.createDataFrame([listing(0, "x", T0 + GAP, T0 + GAP), listing(1, "x", T0, T0)], SCHEMA)
    with pytest.raises(islands.ListingRuleError, match="out of order: 1 listings"):
        islands.check_order(unordered)
    islands.check_order(spark.createDataFrame([listing(0, "x", T0, T0), listing(1, "x", T0, T0)], SCHEMA))
    stale = spark.createDataFrame([listing(0, "x", T0, T0, broken=False), listing(1, "y", T0, T0 + GAP, broken=False)], SCHEMA)
    with pytest.raises(islands.ListingRuleError, match="unbroken"):
        islands.check_unbroken(stale)
    islands.check_unbroken(stale.where("row_id = 1"))


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_id long, a string")
    assert {r["row_id"] for r in islands.keep_first(df, ["a"], ["row_id"]).collect()} == {1, 3}
    assert {r["row_id"] for r in islands.keep_last(df, ["a"], ["row_id"]).collect()} == {2, 3}


def hot_listings(spark, n=4000):
    """Half of all rows under one property, ties, missing values and long sights that later ones fall under."""
    from pyspark.sql import functions as F

    r = F.pmod(F.xxhash64("id"), F.lit(997))
    prop = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("p"), F.col("id") % 300))
    start = F.timestamp_seconds(1_500_000_000 + (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)) * F.pmod(F.xxhash64("id", F.lit(2)), F.lit(400))) * 20_000).cast("timestamp_ntz")
    rows = spark.range(n).select(F.col("id").alias("row_id"), prop.alias("a"), F.lit(1).alias("price_min"), F.lit(1).alias("price_max"), start.alias("first_encounted"), F.when(r > 10, start + F.make_dt_interval(r % 90)).alias("last_encounted"), (r % 2 == 0).alias("sequence_broken"))
    return rows.repartition(3)


@pytest.mark.parametrize("more", [{}, {"running_max": True}, {"null_safe": True}])
def test_segments_of_a_hot_property_give_the_same_islands(spark, more):
    df = hot_listings(spark)
    assert ids(df, segment_rows=150, **more) == ids(df, **more)
    assert ids(df.limit(0), segment_rows=1) == {}


def test_no_segment_holds_more_than_its_share(spark):
    from parcelmill.functions.ordering import SEGMENT, split_by_size

    few, many = split_by_size(hot_listings(spark), ["a"], ["first_encounted", "last_encounted", "row_id"], 150)
    sizes = [r["count"] for r in many.groupBy("a", SEGMENT).count().collect()]
    assert max(sizes) <= 2 * 150 and sum(sizes) + few.count() == 4000
    assert {r["a"] for r in many.select("a").distinct().collect()} == {"hot", None}


def test_parallel_listings_of_a_hot_property(spark):
    df = hot_listings(spark)
    found = {r["row_id"] for r in islands.parallel_listings(df, segment_rows=150).collect()}
    assert found == {r["row_id"] for r in islands.parallel_listings(df).collect()} and len(found) > 100
