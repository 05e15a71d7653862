"""Whole analyses, reports, checks and the sinks that no query reaches."""

from datetime import datetime

import pytest
from conftest import SF
from pyspark.sql import functions as F

from parcelmill import catalogue
from parcelmill.functions import geo, geocode, ordering
from parcelmill.operators import filters, islands, records, stats
from parcelmill.plans import analysis, design_matrix, models
from parcelmill.sources import io


@pytest.fixture(scope="module")
def listings(spark):
    return catalogue._listings(spark, SF).cache()


def test_summary_and_texts(spark, listings, tmp_path):
    found = analysis.data_summary(listings, "sales")
    counts = found["counts"].first()
    assert counts["rows"] == listings.count() and 0 < counts["kept"] <= counts["rows"]
    assert found["rejected"].count() == design_matrix.qc_rejects(listings, "sales").count()
    assert f"Filtered from {counts['rows']} to {counts['kept']} records" in analysis.summary_text(listings, "sales")
    assert f"to {found['rejected'].count()} records" in analysis.qc_text(listings, "sales") and "(none)" in analysis.qc_text(listings, "sales")
    analysis.write_reports(listings, "sales", str(tmp_path))
    assert (tmp_path / "data_notes.txt").read_text() == analysis.summary_text(listings, "sales")
    assert analysis.broken_sequences(listings, "sales").count() >= 0
    assert all(t.count() >= 0 for t in analysis.feature_report(listings).values())


def test_model_analysis(spark, listings):
    spec = [(("bedrooms",), "continuous"), (("bathrooms",), "continuous")]
    found = analysis.model_analysis(listings, "sales", spec=spec)
    n = found["estimates"].where("cv_estimates is not null").count()
    assert n == design_matrix.design_matrix(listings, "sales", spec).table.count() > 0
    assert found["scores"].count() == 5 and found["describe"].first()["n"] == n
    assert found["monthly"].count() <= found["weekly"].count() + 12 and found["density"].count() > 0


def test_comparison_estimates(spark, listings):
    spec = [(("bedrooms",), "continuous")]
    found = analysis.comparison_estimates(listings, "sales", [([(1, 1, 1), (3, 1, 1)], ["House"], ["reid"])], spec).orderBy("bedrooms").collect()
    assert [r["bedrooms"] for r in found] == [1, 3] and all(r["estimate"] is not None for r in found)


def test_parameter_tests_and_their_log(spark, tmp_path):
    table = spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + F.pmod(F.col("id"), F.lit(3))).alias("y"))
    found = models.test_params(table, ["x"], "y", models.ridge, {"alpha": 0.1}, [{}, {"alpha": 5.0}], folds=2)
    assert [r["params"]["alpha"] for r in found.collect()] == ["0.1", "5.0"] and all(len(r["scores"]) == 2 for r in found.collect())
    rows = models.score_log_rows(found)
    io.append_scores(rows, str(tmp_path / "log"))
    io.append_scores(rows, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 4
    for _ in range(2):  # a run that is repeated replaces itself
        io.append_scores(rows, str(tmp_path / "log"), "nightly")
    assert io.read_scores(spark, str(tmp_path / "log")).count() == 6
    assert models.best_by_search(table, ["x"], "y", models.ridge, [{"alpha": 0.1}, {"alpha": 1e6}])[0] == {"alpha": 0.1}


def test_html(spark, tmp_path):
    df = spark.range(3)
    page = io.write_html(df, wrap=False, path=str(tmp_path / "t.html"))
    assert page.count("<tr") == 4 and "nowrap" in page and (tmp_path / "t.html").read_text() == page
    assert "nowrap" not in io.write_html(df)
    with pytest.raises(ValueError):
        io.write_html(df, most_rows=2)


def test_small_functions(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0), (1, "a", None, 2.0), (2, "b", "x", None)], "i int, a string, b string, e double")
    assert stats.error_points(df, "i", F.col("e")).count() == 2
    assert stats.duplicates_report(df, ["a"], ["i"]).count() == 2
    assert df.select(records.same_record(F.struct("a", "b"), F.struct("a", "b"))).distinct().collect() == [(True,)]
    assert df.where(filters.in_category("a", "b", "c")).count() == 1
    assert spark.range(1).select(stats.unscaled(F.lit(1.5), 10.0, 2.0)).first()[0] == 13.0
    assert isinstance(geo.format_value(12.5), str)


def test_strict_geocoding(spark):
    asked = spark.createDataFrame([(0, None, "4", "high st", "reid", "act", 2612), (1, None, "4", "high st", "reid", "nsw", 2612)], "row_id long, house string, house_number string, road string, suburb string, state string, postcode int")
    known = spark.createDataFrame([("4", "High St", "Reid", "Australian Capital Territory", "2612", 149.1, -35.3, 0)], "number string, street string, city string, region string, postcode string, x double, y double, hit_rank int")
    got = {strict: [r["geocoding_is_valid"] for r in geocode.geocode(asked, known, strict=strict).orderBy("row_id").collect()] for strict in (False, True)}
    assert got == {False: [True, True], True: [True, False]}


STORE = "row_id long, name string, price_min double, price_max double, first_encounted timestamp_ntz, last_encounted timestamp_ntz, sequence_broken boolean"


def day(n):
    return datetime(2020, 1, n)


def test_parallel_listings_are_an_error(spark):
    fine = spark.createDataFrame([(0, "a", 1.0, 1.0, day(1), day(3), True), (1, "a", 1.0, 1.0, day(3), day(5), False)], STORE)
    beside = fine.union(spark.createDataFrame([(2, "a", 1.0, 1.0, day(4), day(6), False)], STORE))
    assert islands.check_and_unduplicate(fine, ordered=True, unbroken=True, parallel=True).count() == 1
    with pytest.raises(islands.ListingRuleError, match="side by side"):
        islands.check_and_unduplicate(beside, parallel=True)
    with pytest.raises(islands.ListingRuleError, match="unbroken"):
        islands.check_and_unduplicate(beside, unbroken=True)
    swapped = spark.createDataFrame([(1, "a", 1.0, 1.0, day(1), day(3), True), (0, "a", 1.0, 1.0, day(3), day(5), False)], STORE)
    with pytest.raises(islands.ListingRuleError, match="out of order"):
        islands.check_and_unduplicate(swapped, ordered=True)
    assert islands.check_and_unduplicate(swapped).count() == 1


def test_a_broken_write_leaves_the_store_as_it_was(spark, tmp_path):
    store = io.Store(spark, f"file://{tmp_path}/store", kept=2)
    with pytest.raises(FileNotFoundError):
        store.read()
    for n in range(1, 5):
        store.write(spark.range(n))
    # A write that broke off: files, but no mark that they are all there.
    spark.range(9).write.parquet(f"file://{tmp_path}/store/v-{5:012d}")
    (tmp_path / "store" / f"v-{5:012d}" / "_SUCCESS").unlink()
    assert store.exists() and store.read().count() == 4
    store.create_unless_exists(spark.range(1))
    assert store.read().count() == 4
    store.write(spark.range(7))
    assert store.read().count() == 7
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == [f"v-{n:012d}" for n in (4, 5, 6)]


def test_matrix_round_trip_keeps_groups(spark, listings, tmp_path):
    matrix = design_matrix.build(listings, [(("bedrooms",), "continuous"), (("bathrooms",), "numerically_encoded"), (("bedrooms", "property_type"), "linear_by_categorical"), (("property_type",), "categorical")])
    io.write_matrix(matrix, str(tmp_path / "m"))
    back = io.read_matrix(spark, str(tmp_path / "m"))
    for part in ("columns", "categorical_groups", "interaction_groups", "encoded_columns", "encoders"):
        assert getattr(back, part) == getattr(matrix, part), part
    assert design_matrix.identifiable(back) == design_matrix.identifiable(matrix)
    io.write_xy_csv(matrix, str(tmp_path / "xy"))
    x, y = (spark.read.option("header", True).csv(str(tmp_path / "xy" / n)) for n in "xy")
    assert x.columns == ["row_id", *matrix.columns] and x.count() == y.count() == matrix.table.count()


def test_positions_of_sparse_keys(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k")).cache()
    got = [r["k"] for r in ordering.dense_index(keys, "k", "at", bucket=50).orderBy("at").collect()]
    assert got == sorted(r["k"] for r in keys.collect())
    assert ordering.dense_index(keys.limit(0), "k", "at").count() == 0


def test_a_hot_group_is_split(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500).alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = filters.min_population(rows, "g", 2)
        assert len(found.collect()) == rows.where("g is not null").count()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
