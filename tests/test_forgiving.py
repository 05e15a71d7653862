"""Hits that forgive spelling against measuring every street of a suburb."""

import random

from pyspark.sql import functions as F

from parcelmill.functions import geocode


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def misspelt(rng, name, times):
    for _ in range(times):
        at = rng.randrange(len(name) + 1)
        name = rng.choice([name[:at] + rng.choice("abc ") + name[at:], name[:at] + name[at + 1 :], name[:at] + rng.choice("xyz") + name[at + 1 :]])
    return name


def names(rng, n):
    return sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for _ in range(n)})


def test_near_streets_equal_brute_force(spark):
    rng = random.Random(1)
    streets = [(s, t) for s in ("p", "q") for t in names(rng, 120)]
    roads = [(rng.choice("pq"), misspelt(rng, t, rng.randint(0, 3))) for _, t in streets] + [(None, "abc"), ("p", None), ("z", streets[0][1])]
    got = geocode.near_streets(spark.createDataFrame(roads, "suburb string, road string"), spark.createDataFrame(streets + streets[:5], "suburb string, street string")).collect()
    want = {(s, r, t, edits(r, t)) for s, r in roads if s and r is not None for u, t in streets if u == s and (r == t or min(len(r), len(t)) >= geocode.LEAST_CHARS and edits(r, t) <= geocode.MOST_EDITS)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 200
    assert any(e == 2 for *_, e in want) and any(e == 1 for *_, e in want)


def test_hits_are_ranked_and_rows_without_one_stay(spark):
    gazetteer = spark.createDataFrame([("5", "High Street", "Reid", 1.0, 2.0, 2), ("5", "High Street", "Reid", 3.0, 4.0, 1), ("5", "High Streets", "Reid", 5.0, 6.0, 1), ("5", "High Street", "Ainslie", 9.0, 9.0, 1), ("6", "Low Road", "Reid", 7.0, 8.0, None)], "number string, street string, city string, x double, y double, hit_rank int")
    asked = spark.createDataFrame([(0, "", "2/5", "high street", "reid"), (1, "", "5", "hgh street", "REID"), (2, "", "5", "nowhere", "reid"), (3, "", None, "high street", "reid"), (4, "", "6", "low rod", "reid"), (5, "", "6", "low rod", None), (4, "", "6", "low rod", "reid")], "row_id long, house string, house_number string, road string, suburb string")
    got = geocode.geocode_forgiving(asked, gazetteer)
    assert sorted((r["row_id"], r["longitude"], r["street_found"], r["edits"], r["geocoding_is_valid"]) for r in got.where("row_id < 5").collect() if r["geocoding_is_valid"]) == [(0, 3.0, "high street", 0, True), (1, 3.0, "high street", 1, True), (4, 7.0, "low road", 1, True), (4, 7.0, "low road", 1, True)]
    assert {r["row_id"] for r in got.where(~F.col("geocoding_is_valid")).collect()} == {2, 3, 5} and got.count() == 7
    assert geocode.geocode_forgiving(asked, gazetteer.limit(0)).where("geocoding_is_valid").count() == 0
