from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parcelmill.operators import records, sequences

STORE = "row_id long, name string, size int, first_encounted timestamp_ntz, last_encounted timestamp_ntz, sequence_broken boolean"
BATCH = "batch_row_id long, name string, size int, date_scraped timestamp_ntz"
NOW = datetime(2020, 6, 15)


def day(month, d):
    return datetime(2020, month, d)


def store(spark):
    return spark.createDataFrame([
        (0, "seen", 1, day(4, 1), day(6, 1), False),
        (1, "broken", 1, day(1, 1), day(2, 1), True),
        (2, "old", 1, day(1, 1), day(5, 15), False),
        (3, "young", 1, day(1, 1), day(5, 16), False),
        (4, None, None, day(5, 1), day(6, 1), False),
        (5, "undated", 1, day(5, 1), None, False),
        (6, "unflagged", 1, day(5, 1), day(6, 1), None),
    ], STORE)


def batch(spark):
    return spark.createDataFrame([
        (0, "seen", 1, day(6, 15)), (1, "seen", 1, day(6, 14)), (2, "broken", 1, day(6, 15)), (3, "old", 1, day(6, 15)),
        (4, None, None, day(6, 15)), (5, "new", 2, day(6, 15)), (6, "new", 2, day(6, 15)), (7, "seen", 2, day(6, 15)),
        (8, "undated", 1, day(6, 15)), (9, "unflagged", 1, day(6, 15)),
    ], BATCH)


def rows(df):
    return {r["row_id"]: tuple(r[c] for c in ("name", "size", "first_encounted", "last_encounted", "sequence_broken")) for r in df.collect()}


def test_upsert(spark):
    found = rows(sequences.upsert(store(spark), batch(spark), NOW))
    assert found[0] == ("seen", 1, day(4, 1), day(6, 15), False)  # refreshed to the first batch row
    assert found[1] == ("broken", 1, day(1, 1), day(2, 1), True)
    assert found[2] == ("old", 1, day(1, 1), day(5, 15), True)  # exactly 31 days old
    assert found[3] == ("young", 1, day(1, 1), day(5, 16), False)
    assert found[4] == (None, None, day(5, 1), day(6, 15), False)  # missing ids match
    assert found[5] == ("undated", 1, day(5, 1), None, False)  # never refreshed, yet matched
    assert found[6][-1] is None
    inserted = [found[i][0] for i in range(7, len(found))]
    assert inserted == ["broken", "old", "new", "new", "seen", "unflagged"]  # in batch order


def test_upsert_is_idempotent(spark):
    once = sequences.upsert(store(spark), batch(spark), NOW)
    assert rows(sequences.upsert(once, batch(spark), NOW)) == rows(once)


def test_late_batch_moves_back(spark):
    late = spark.createDataFrame([(0, "seen", 1, day(5, 20))], BATCH)
    assert rows(sequences.upsert(store(spark), late, NOW))[0][3] == day(5, 20)


def test_layouts(spark):
    old = spark.createDataFrame([(0, "a", day(1, 1))], "row_id long, name string, datetime timestamp_ntz")
    new = records.upgrade_layout(old)
    assert {"address_text", "state", "postcode", "first_encounted", "sequence_broken"} <= set(new.columns)
    assert records.upgrade_layout(new).columns == new.columns
    with pytest.raises(ValueError):
        records.upgrade_layout(spark.createDataFrame([(1,)], "row_id long"))


def test_empty_batch_is_an_error(spark):
    with pytest.raises(ValueError):
        records.batch_of(spark.createDataFrame([], records.RECORD), NOW)


def test_required_values(spark):
    ok = spark.createDataFrame([("House", "act")], "property_type string, state string")
    assert records.checked(ok).count() == 1
    with pytest.raises(Exception, match="state is missing"):
        records.checked(ok.withColumn("state", F.lit(None).cast("string"))).collect()
