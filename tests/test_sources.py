import json
from datetime import datetime

import pytest

from parcelmill.operators import records
from parcelmill.sources import io, web
from parcelmill.sources.settings import Settings
from parcelmill.streaming.upserts import apply_batch, stream_upserts

STORE = "row_id long, name string, price_min double, price_max double, first_encounted timestamp_ntz, last_encounted timestamp_ntz, sequence_broken boolean"
T = datetime(2020, 1, 2, 3, 4, 5)


def one(spark):
    return spark.createDataFrame([(0, "a", 1.0, None, T, T, False), (1, "b", 2.0, 3.0, T, T, True)], STORE)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    io.write_table(one(spark), kind, str(tmp_path / "t"))
    back = io.read_table(spark, kind, str(tmp_path / "t"))
    assert sorted(map(tuple, back.select(*one(spark).columns).collect())) == sorted(map(tuple, one(spark).collect()))


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        io.read_table(spark, "hdf", "x")


def test_versioned_store(spark, tmp_path):
    store = io.Store(spark, f"file://{tmp_path}/store")
    assert not store.exists()
    store.create_unless_exists(one(spark))
    store.create_unless_exists(one(spark).where("false"))
    assert store.read().count() == 2
    batch = spark.createDataFrame([(0, "c", 5.0, 6.0, None, None, None, T)], "batch_row_id long, name string, price_min double, price_max double, address_text string, state string, postcode int, date_scraped timestamp_ntz")
    io.update_store(store, batch, T)
    assert store.read().count() == 3


def test_stream_equals_batches(spark, tmp_path):
    schema = "batch_row_id long, name string, date_scraped timestamp_ntz"
    for i in range(3):
        spark.createDataFrame([(0, "a", datetime(2020, 1, 1 + i)), (1, f"n{i}", datetime(2020, 1, 1 + i))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/d={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streamed = io.Store(spark, f"file://{tmp_path}/streamed")
    stream_upserts(stream, streamed, str(tmp_path / "ck")).awaitTermination()
    batched = io.Store(spark, f"file://{tmp_path}/batched")
    for i in range(3):
        apply_batch(batched, spark.read.parquet(str(tmp_path / f"in/d={i}")).select("batch_row_id", "name", "date_scraped"))
    cols = ["name", "first_encounted", "last_encounted", "sequence_broken"]
    assert sorted(map(tuple, streamed.read().select(*cols).collect())) == sorted(map(tuple, batched.read().select(*cols).collect()))
    assert batched.read().count() == 4


def test_pages(spark, tmp_path):
    io.dump_json({"htmls": ["<a>", "<b>"], "search_description": "act 2600"}, str(tmp_path / "p.json"))
    assert io.load_json(str(tmp_path / "p.json"))["htmls"] == ["<a>", "<b>"]
    pages = io.read_pages(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in pages.orderBy("page").collect()] == [("act 2600", 0, "<a>"), ("act 2600", 1, "<b>")]
    io.write_pages(pages, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["htmls"] == ["<a>", "<b>"]


def test_matrix_round_trip(spark, tmp_path):
    from parcelmill.plans.design_matrix import build

    m = build(one(spark), [(("price_min",), "polynomial")])
    io.write_matrix(m, str(tmp_path / "m"))
    back = io.read_matrix(spark, str(tmp_path / "m"))
    assert back.columns == m.columns and back.table.count() == 2


def test_failure_log(spark):
    df = spark.createDataFrame([(2, "b"), (1, "b"), (3, "a"), (4, None)], "row_id long, error_type string")
    assert {r["row_id"]: r["error_number"] for r in records.failure_log(df).collect()} == {3: 0, 1: 1, 2: 2, 4: 3}


def test_fetching():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("no")
        return "page"

    assert web.with_attempts(flaky, "u") == "page" and len(calls) == 3
    with pytest.raises(OSError):
        web.with_attempts(lambda u: (_ for _ in ()).throw(OSError("no")), "u", 2)
    waits = []
    with pytest.raises(OSError):
        web.with_backoff(lambda u: (_ for _ in ()).throw(OSError("no")), "u", sleep=waits.append)
    assert waits == [0.1, 0.2, 0.4, 0.8, 1.6, 3.2]
    pages = {1: "x", 2: "y", 3: "no results", 4: "z"}
    got = list(web.pages_until_empty(lambda u: pages[int(u)], str, 1, 4, lambda h: "no results" in h))
    assert got == [(1, "x"), (2, "y")]


def test_listing_pages_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"list-{n}").write_text(f"page {n}")
    (tmp_path / "list-3").write_text("no results")
    spark.dataSource.register(web.ListingPages)
    df = spark.read.format("listing_pages").option("base", f"file://{tmp_path}/list").option("lastPage", "9").load()
    assert [(r["page"], r["html"]) for r in df.orderBy("page").collect()] == [(1, "page 1"), (2, "page 2")]


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path):
    """Stopped after one step, broken off inside the next, and run again twice: each page is stored once."""
    site, store = tmp_path / "site", str(tmp_path / "pages")
    places = [("act", 2600 + i) for i in range(5)]
    for state, code in places:
        for n in range(1, 4):
            url = web.page_url_of(str(site) + "/", n, code, state, "")
            (tmp_path / url).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / url).write_text(f"{code} {n}" if n < 3 else "no results")
    options = {"base": f"file://{site}/", "lastPage": "9"}
    assert web.crawl(spark, store, places, 2, most_steps=1, **options).count() == 4
    broken = tmp_path / "pages" / "step-000000002-2"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half a file")
    (site.parent / web.page_url_of(str(site) + "/", 1, 2600, "act", "")).write_text("changed: not fetched again")
    for _ in range(2):
        got = web.crawl(spark, store, places, 2, **options)
        assert sorted((r["postcode"], r["page"], r["html"]) for r in got.collect()) == [(c, n, f"{c} {n}") for _, c in places for n in (1, 2)]
    assert web.crawl(spark, str(tmp_path / "none"), [], **options).count() == 0


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "sales": {"limit": 1, "act": {"limit": 2, "out_path": "out/x.csv"}}}))
    s = Settings.load(str(tmp_path / "s.json"), "sales", "act", str(tmp_path))
    assert s["limit"] == 2 and s["name"] == "n"
    assert s.path("out_path").parent.is_dir()
    with pytest.raises(KeyError):
        Settings.load(str(tmp_path / "s.json"), "rentals")
