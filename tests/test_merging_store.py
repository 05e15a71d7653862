"""The merging store against a plain model of rewriting everything after each batch."""

import random
from datetime import datetime, timedelta

import pytest

from parcelmill.operators import sequences
from parcelmill.sources.merging_store import ConflictError, MergingStore
from parcelmill.streaming.upserts import apply_batch

ROWS = "row_id long, name string, size int, first_encounted timestamp_ntz, last_encounted timestamp_ntz, sequence_broken boolean"
BATCH = "batch_row_id long, name string, size int, date_scraped timestamp_ntz"
T0 = datetime(2020, 1, 1)


def rewritten(store, batch, time, days=31):
    """The store after a batch, in plain Python: rows by row id."""
    store = {i: list(r) for i, r in store.items()}
    for r in store.values():
        if r[4] is False:
            r[4] = r[3] is not None and r[3] <= time - timedelta(days)
    firsts = {}
    for i, name, size, seen in batch:
        firsts.setdefault((name, size), seen)
    open_ = {(r[0], r[1]) for r in store.values() if r[4] is False}
    for r in store.values():
        if r[4] is False and r[2] is not None and r[3] is not None and (r[0], r[1]) in firsts:
            r[3] = firsts[r[0], r[1]]
    new = max(store, default=-1) + 1
    for i, name, size, seen in batch:
        if (name, size) not in open_:
            store[new] = [name, size, seen, seen, False]
            new += 1
    return store


def rows_of(df):
    return {r["row_id"]: [r[c] for c in ("name", "size", "first_encounted", "last_encounted", "sequence_broken")] for r in df.collect()}


def a_batch(rng, day, most=12, names="abcdefghij"):
    found = []
    for i in range(rng.randint(0, most)):
        found.append((i, rng.choice([*names, None]), rng.choice([1, 2, None]), T0 + timedelta(day, rng.randint(-3000, 0))))
    return found


START = [(3, "a", 1, T0, T0, False), (5, None, None, T0, T0, False), (6, "b", 1, T0, None, False), (7, "c", 1, T0, T0, None), (8, "d", 2, T0, T0, True)]


@pytest.fixture
def store(spark, tmp_path):
    found = MergingStore(spark, str(tmp_path / "store"), most_layers=4)
    found.create(spark.createDataFrame(START, ROWS), ["name", "size"], buckets=5)
    return found


def test_fifty_batches_leave_what_rewriting_leaves(spark, store):
    rng = random.Random(3)
    want = {r[0]: list(r[1:]) for r in START}
    assert rows_of(store.read()) == want
    day = 0
    for n in range(50):
        day += rng.choice([1, 5, 12, 40, -6])  # late and early scrapes
        batch = a_batch(rng, day)
        time = T0 + timedelta(day)
        want = rewritten(want, batch, time)
        store.upsert(spark.createDataFrame(batch, BATCH), time)
        if n % 10 == 9:
            assert rows_of(store.read()) == want
        if n == 24:
            store.compact()
            assert rows_of(store.read()) == want
    assert max(len(ls) for ls in store.manifest()["layers"].values()) <= 5
    assert len(store._files.names("manifests")) == 3


def test_batches_equal_the_operator(spark, store):
    rng = random.Random(4)
    whole = spark.createDataFrame(START, ROWS)
    for day in (3, 20, 60):
        batch = spark.createDataFrame(a_batch(rng, day), BATCH)
        whole = spark.createDataFrame(sequences.upsert(whole, batch, T0 + timedelta(day)).collect(), ROWS)
        store.upsert(batch, T0 + timedelta(day))
    assert rows_of(store.read()) == rows_of(whole)


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """A batch of ten rows writes as little to a store of 40 000 rows as to one of 400."""
    wrote = {}
    for n in (400, 40_000):
        found = MergingStore(spark, str(tmp_path / f"s{n}"))
        found.create(spark.range(n).selectExpr("id AS row_id", "concat('n', id) AS name", "CAST(id % 9 AS INT) AS size", "TIMESTAMP_NTZ '2020-01-01' AS first_encounted", "TIMESTAMP_NTZ '2020-01-01' AS last_encounted", "false AS sequence_broken"), ["name", "size"], buckets=8)
        base = set(found.layer_bytes())
        found.upsert(spark.createDataFrame([(i, f"n{i}", i % 9, T0 + timedelta(2)) for i in range(10)], BATCH), T0 + timedelta(2))
        sizes = found.layer_bytes()
        wrote[n] = sum(v for k, v in sizes.items() if k not in base)
        assert found.read().where("last_encounted > TIMESTAMP_NTZ '2020-01-01'").count() == 10
        # Breaking all others later writes nothing for them either.
        found.upsert(spark.createDataFrame([(0, "n0", 0, T0 + timedelta(90))], BATCH), T0 + timedelta(90))
        assert found.read().where("sequence_broken").count() == n
        wrote[n, "later"] = sum(v for k, v in found.layer_bytes().items() if k not in sizes)
    assert wrote[40_000] < 1.2 * wrote[400] and wrote[40_000, "later"] < 1.2 * wrote[400, "later"]


def test_untouched_buckets_are_not_read(spark, store):
    from pyspark.sql import functions as F

    manifest = store.manifest()
    kept = [int(b) for b in manifest["layers"]][:1]
    paths = store._state(manifest, kept).select(F.input_file_name().alias("f")).distinct().collect()
    assert all(f"_bucket={kept[0]}/" in r["f"] for r in paths)


def test_one_of_two_writers_of_a_version_fails(spark, store):
    other = MergingStore(spark, store.path)
    old = other.manifest()
    store.upsert(spark.createDataFrame([(0, "z", 1, T0)], BATCH), T0)
    other.manifest = lambda: old
    with pytest.raises(ConflictError):
        other.upsert(spark.createDataFrame([(0, "y", 1, T0)], BATCH), T0)
    assert {r[0] for r in rows_of(store.read()).values()} == {"a", "b", "c", "d", "z", None}


def test_a_write_that_breaks_off_changes_nothing(spark, store, monkeypatch):
    before = rows_of(store.read())
    monkeypatch.setattr(MergingStore, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([(0, "z", 1, T0)], BATCH), T0)
    monkeypatch.undo()
    assert rows_of(store.read()) == before
    store.upsert(spark.createDataFrame([(0, "z", 1, T0)], BATCH), T0)
    assert len(rows_of(store.read())) == len(before) + 1


def test_batches_of_a_stream_count_once(spark, store):
    """Micro-batches that are repeated after a failure are passed over by their number."""
    batch = spark.createDataFrame([(0, "z", 1, T0 + timedelta(50)), (1, "z", 1, T0 + timedelta(50))], BATCH)
    apply_batch(store, batch, batch_id=0)
    once = rows_of(store.read())
    apply_batch(store, batch, batch_id=0)
    assert rows_of(store.read()) == once and store.manifest()["batches"] == {"stream": 0}
    apply_batch(store, batch.limit(0), batch_id=1)
    assert rows_of(store.read()) == once


def test_a_stream_makes_and_feeds_the_store(spark, tmp_path):
    from parcelmill.streaming.upserts import stream_upserts

    for i, day in enumerate((1, 2, 60)):
        spark.createDataFrame([(i, "s", 1, T0 + timedelta(day))], BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = MergingStore(spark, str(tmp_path / "out"))
        stream_upserts(spark.readStream.schema(BATCH).parquet(str(tmp_path / "in")), found, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted((r[2] - T0, r[3] - T0, r[4]) for r in rows_of(found.read()).values()) == [(timedelta(1), timedelta(2), True), (timedelta(60), timedelta(60), False)]


def test_other_columns_are_an_error(spark, store):
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(0, "z", T0)], "batch_row_id long, name string, date_scraped timestamp_ntz"), T0)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from parcelmill.sources.shared import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    assert shared_folder(session("local[2]")).startswith("file://")
