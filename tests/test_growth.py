"""What must not grow with the tables: broadcasts, rows that meet, tasks of segments, blocks of tree learners."""

import math
from collections import Counter

import pytest
from conftest import SF
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from parcelmill import catalogue
from parcelmill.functions import geo, geocode, ordering
from parcelmill.plans import models


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbour_joins_broadcast_no_points(spark):
    points = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    near = geo.radius_join(points, "k", "x", "y", 2.0)
    assert "Broadcast" not in executed(near)
    assert "Broadcast" not in executed(geo.knn_join(points, "k", "x", "y", 3))
    rows = points.collect()
    want = {(a.k, b.k) for a in rows for b in rows if a.k != b.k and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4}
    assert {(r["i"], r["j"]) for r in near.collect()} == want


def rows_of_joins(df) -> list[int]:
    """Rows that the merge joins of a plan made when it ran."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            open_.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            open_.append(node.plan())
        elif node.nodeName() == "SortMergeJoin":
            found.append(node.metrics().apply("numOutputRows").value())
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("most", [1024, 5])
def test_places_meet_with_lists_of_their_points(spark, monkeypatch, most):
    """600 points at 24 places: over 60 000 pairs, but no more rows meet than pairs of lists."""
    monkeypatch.setattr(geo, "LIST", most)
    k = F.col("id")
    points = spark.range(600).select((k % 590).alias("k"), (k % 6 - 3).cast("double").alias("x"), (F.floor(k / 6) % 4 * 1.1 - 2).alias("y"))
    odd = spark.createDataFrame([(700, None, 0.0), (None, 0.0, -2.0), (701, -0.0, -2.0), (702, float("nan"), 0.0), (703, 2.0 - 1e-16, 1e9)], "k long, x double, y double")
    near = geo.radius_join(points.unionByName(odd), "k", "x", "y", 1.2, digits=9)
    got = Counter((r["i"], r["j"], r["w"]) for r in near.collect())
    rows = [r for r in points.unionByName(odd).collect() if None not in tuple(r)]
    apart = [(a.k, b.k, math.hypot(a.x - b.x, a.y - b.y)) for a in rows for b in rows if a.k != b.k]
    assert got == Counter((i, j, round(w, 9)) for i, j, w in apart if w <= 1.2)
    chunks = -(-26 // most)
    assert 0 < max(rows_of_joins(near)) <= (24 * chunks + 3) * 9 * chunks < 60_000 < sum(got.values())


@pytest.mark.parametrize("most", [200_000, 1])
def test_addresses_meet_two_hits_at_most(spark, monkeypatch, most):
    """400 addresses of one suburb and number, 401 entries there: 160 400 pairs, of which none but the best count."""
    monkeypatch.setattr(geocode, "BROADCAST_ROWS", most)
    k = F.col("id")
    asked = spark.range(400).select(k.alias("row_id"), F.lit(None).cast("string").alias("house"), F.lit("5").alias("house_number"), F.concat(F.lit("street "), (k % 5).cast("string")).alias("road"), F.lit("reid").alias("suburb"), F.lit("act").alias("state"), F.lit(2612).alias("postcode"))
    entry = lambda rows, rank: rows.select(F.lit("5").alias("number"), F.concat(F.lit("Street "), (k % 4).cast("string")).alias("street"), F.lit("Reid").alias("city"), F.lit("ACT").alias("region"), F.lit("2612").alias("postcode"), k.cast("double").alias("x"), (k * 2).cast("double").alias("y"), rank.alias("hit_rank"))
    gazetteer = entry(spark.range(400), 1000 - k).unionByName(entry(spark.range(400, 401), F.lit(None).cast("long")))
    found = geocode.geocode(asked, gazetteer)
    got = {r["row_id"]: (r["longitude"], r["latitude"], r["geocoding_is_valid"]) for r in found.collect()}
    # The smallest rank of the own street; where there is none, of the suburb and number.
    best = {0: 396.0, 1: 397.0, 2: 398.0, 3: 399.0, 4: 399.0}
    assert got == {i: (best[i % 5], 2 * best[i % 5], i % 5 < 4) for i in range(400)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 2


def test_positions_are_numbered_where_the_ranges_lie(spark):
    keys = spark.range(1000).select(F.expr("(id * 7919) % 1000").alias("k"))
    found = ordering.dense_index(keys, "k", "at", bucket=50)
    assert "row_number" not in executed(found)
    assert all(r["k"] == r["at"] for r in found.collect())
    assert found.rdd.getNumPartitions() <= 20


def test_folds_are_checked_without_a_join_of_ids(spark, monkeypatch):
    kind = type(spark.range(1))
    joins, join = [], kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: joins.append(how) or join(self, other, on, how))
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), (2 * F.col("id") + 1).cast("double").alias("y"))
    found, _ = models.cross_validate(rows, ["a"], "y", models.ols)
    assert found.count() == 60 and "left_anti" not in joins


def test_small_segments_do_not_cost_a_task_each(spark):
    rows = spark.range(0, 3000, 1, 4).select(F.lit("x").alias("a"), F.expr("(id * 7919) % 3000").alias("k"))
    few, many = ordering.split_by_size(rows, ["a"], ["k"], 10)
    assert few.count() == 0 and len(many.inputFiles()) == 1
    segments = many.groupBy(ordering.SEGMENT).agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy(ordering.SEGMENT).collect()
    assert len(segments) == 300 and all(s["n"] == 10 for s in segments)
    assert all(a["high"] < b["low"] for a, b in zip(segments, segments[1:]))


def test_tree_learners_get_small_blocks_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 100)
    rows = models.assembled(spark.range(0, 1000, 1, 1).select(F.col("id").alias("row_id"), (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 91).cast("double").alias("y")), ["a"])
    sizes = models.dealt(rows, "features", "y").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110
    assert models.dealt(rows, "features", "y", 1000) is rows
    fitted = [models.boosted(r, "features", "y", maxIter=2).toDebugString.splitlines()[1:] for r in (rows, rows)]
    assert fitted[0] == fitted[1]


def test_boosted_estimates_ask_for_the_whole_model(spark, monkeypatch):
    """All 3000 trees as deep as MLlib lets them grow; the fit itself is cut short here, to see what was asked for."""
    asked = {}
    monkeypatch.setattr(models, "GBTRegressor", lambda **params: asked.update(params) or GBTRegressor(**{**params, "maxIter": 2, "maxDepth": 2}))
    rows = catalogue.boosted_estimates(spark, SF)
    assert (asked["maxIter"], asked["maxDepth"], asked["stepSize"], asked["subsamplingRate"], asked["lossType"]) == (3000, 30, 0.01, 0.5, "absolute")
    assert rows.where("estimate IS NOT NULL").count() == spark.read.parquet(f"{SF}/part.parquet").count()
    assert spark.sparkContext.getCheckpointDir() is not None
