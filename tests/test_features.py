import pytest
from pyspark.sql import functions as F

from parcelmill.operators import filters, stats
from parcelmill.plans import analysis, models
from parcelmill.plans import design_matrix as dm

SCHEMA = "row_id long, sale_type string, under_contract boolean, price_min double, price_max double, property_type string, bedrooms int, bathrooms int, garage_spaces int, suburb string, geocoding_is_valid boolean"
ROWS = [
    (0, "Private Treaty", False, 900000.0, 1100000.0, "House", 3, 2, 1, "reid", True),
    (1, "Private Treaty", False, 500000.0, None, "Unit", 2, None, 9, "phillip", True),
    (2, "Private Treaty", False, 500000.0, 600000.0, "Not Specified", 1, 1, 1, None, True),
    (3, "Auction", False, 500000.0, 500000.0, "House", 1, 1, 1, "reid", True),
    (4, "Private Treaty", False, 100.0, 100.0, "House", 1, 1, 1, "reid", True),
    (5, "Private Treaty", False, 400000.0, 400000.0, "House", 4, 1, 1, "reid", False),
    (6, "Rental", False, 100.0, 150.0, "House", 4, 1, 1, "reid", True),
]
SPEC = [(("bedrooms",), "polynomial"), (("garage_spaces",), "ordinal"), (("bedrooms", "property_type"), "linear_by_categorical"), (("property_type",), "categorical"), (("suburb",), "categorical")]


@pytest.fixture
def listings(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_accepted_rows(listings):
    assert {r["row_id"] for r in dm.accepted(listings, "sales").collect()} == {0, 2}  # row 1 lacks its upper price
    assert {r["row_id"] for r in dm.accepted(listings, "rentals").collect()} == {6}
    assert {r["row_id"] for r in dm.accepted(listings, "sales", geocoded=False).collect()} == {0, 2, 5}
    with pytest.raises(ValueError):
        dm.accepted(listings, "leases")


def test_rejects_hold_missing_prices(listings):
    assert {r["row_id"] for r in dm.qc_rejects(listings, "sales").collect()} == {1, 4, 6}


def test_population(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a", None, "b", None, "a"])], "n long, suburb string")
    assert {r["n"] for r in filters.min_population(df, "suburb", 2).collect()} == {0, 1, 5}
    report = filters.min_population_report(df, "suburb", 2).first()
    assert tuple(report) == (6, 3, 3, 1)


def test_matrix_columns_and_values(listings):
    m = dm.build(dm.fill_counts(listings.where("row_id < 3")), SPEC)
    assert m.columns == ["bedrooms", "bedrooms_^2", "bedrooms_^3", "bedrooms_by_House", "bedrooms_by_Unit", "garage_spaces_8", "property_type_House", "property_type_Unit", "suburb_phillip", "suburb_reid"]
    got = {r["row_id"]: [r[c] for c in m.columns] + [r["y"]] for r in m.table.collect()}
    assert got[0] == [3, 9, 27, 3, 0, 0, 1, 0, 0, 1, 1000000.0]
    assert got[1] == [2, 4, 8, 0, 2, 1, 0, 1, 1, 0, 500000.0]
    assert got[2] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 550000.0]
    assert m.categorical_groups == [("garage_spaces", 5, 6), ("property_type", 6, 8), ("suburb", 8, 10)]
    assert m.interaction_groups == [("bedrooms", "property_type", 3, 5)]


def test_identifiable_columns(listings):
    m = dm.build(listings.where("row_id < 2"), SPEC)
    kept = dm.identifiable(m)
    assert "property_type_Unit" not in kept and "property_type_House" in kept  # no row without a dummy
    assert "bedrooms_by_House" not in kept  # one value besides 0


def test_spec_checks():
    with pytest.raises(RuntimeError):
        dm.check_spec([(("a",), "categorical"), (("b",), "continuous")])
    with pytest.raises(ValueError):
        dm.check_spec([(("a",), "cubic")])


def test_encoder_round_trip(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    values = dm.encoder(df, "c")
    assert values == ["None", "a", "b"]
    got = [r[0] for r in df.select(dm.decode(dm.encode(F.col("c"), values), values)).collect()]
    assert got == ["b", "None", "a"]


def test_one_hot_rows_sum_to_at_most_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "c string, price_min double").withColumn("price_max", F.col("price_min"))
    m = dm.build(df, [(("c",), "categorical")])
    assert {sum(r[c] for c in m.columns) for r in m.table.collect()} == {0, 1}


def test_comparison_encoding(spark):
    rows = dm.combinations(spark, [([(2, 1, 0)], ["House"], ["reid", "phillip"])])
    columns = ["bedrooms", "bedrooms_^2", "bedrooms_by_House", "bedrooms_by_Unit", "property_type_House", "suburb_reid"]
    got = {r["row_id"]: [r[c] for c in columns] for r in dm.encode_like(rows, columns).collect()}
    assert got == {0: [2, 4, 2, 0, 1, 1], 1: [2, 4, 2, 0, 1, 0]}


def test_cross_validation_covers_every_row(spark):
    rows = spark.range(11).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (2 * F.col("id") + 1).cast("double").alias("y"))
    found, scores = models.cross_validate(rows, ["x"], "y", models.ols, 3)
    assert sorted(r["fold"] for r in found.collect()) == [0] * 4 + [1] * 4 + [2] * 3
    assert all(abs(r["r2"] - 1) < 1e-9 for r in scores.collect())
    one, _ = models.cross_validate(rows, ["x"], "y", models.ols, 1)
    assert one.count() == 3  # the first of five


def test_bad_scores_are_errors(spark):
    rows = spark.range(10).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    with pytest.raises(models.BadScoreError):
        models.cross_validate(rows, ["x"], "y", models.ols, 2)


def test_search_and_spatial_fit(spark):
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), (3 * (F.col("id") % 7) + 5 + (F.col("id") % 2)).cast("double").alias("y"))
    best, _ = models.best_by_search(rows, ["x"], "y", models.ridge, [{"alpha": 0.1}, {"alpha": 1000.0}])
    assert best == {"alpha": 0.1}
    tested = models.test_params(rows, ["x"], "y", models.ridge, {"alpha": 0.1}, [{}, {"alpha": 5.0}], 2)
    assert tested.count() == 2
    ring = spark.range(60).select(F.col("id").alias("i"), ((F.col("id") + 1) % 60).alias("j"), F.lit(1.0).alias("w"))
    intercept, (slope,), lam = models.spatial_error_fit(rows, ["x"], "y", ring)
    assert abs(slope - 3) < 0.2 and -1 < lam < 1 and abs(intercept - 5.5) < 1


def test_feature_report(listings):
    report = analysis.feature_report(listings)
    assert report["property_type_bedrooms"].columns[-1].endswith("+")
    assert {tuple(r) for r in report["suburb_count"].collect()} == {("reid", 5), ("phillip", 1)}


def test_bins_need_sorted_breaks(spark):
    with pytest.raises(ValueError):
        stats.bin_of(F.lit(1), [2.0, 1.0])


def test_map_breaks_ascend():
    for kind in ("sales", "rentals", "yields"):
        for name in ("House", "Unit", "Studio", "Land"):
            found = stats.map_breaks(kind, name)
            assert list(found) == sorted(found)
    with pytest.raises(ValueError):
        stats.map_breaks("loans", "House")


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_codes_by_a_level_table(spark, monkeypatch, broadcast):
    """The codes of the encoder, missing values as a level, unknown ones as null, whether levels are broadcast or joined."""
    monkeypatch.setattr(dm, "BROADCAST_LEVELS", broadcast)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "b", "Z", ""])], "row_id long, `v.x` string")
    levels = dm.level_table(df, "v.x")
    values = sorted({"b", "a", "None", "Z", ""})
    assert {r["value"]: r["code"] for r in levels.collect()} == {v: i for i, v in enumerate(values)}
    more = df.unionByName(spark.createDataFrame([(9, "new")], df.schema))
    coded = dm.encode_joined(more, "v.x", levels, "code")
    assert {r["row_id"]: r["code"] for r in coded.collect()} == {**{i: values.index(v if v is not None else "None") for i, v in enumerate(["b", "a", None, "b", "Z", ""])}, 9: None}
    back = dm.decode_joined(coded, "code", levels, "text")
    assert {r["row_id"]: r["text"] for r in back.collect()} == {0: "b", 1: "a", 2: "None", 3: "b", 4: "Z", 5: "", 9: None}
