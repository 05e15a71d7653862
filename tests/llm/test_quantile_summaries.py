"""Quantile summaries against sorting, with small limits so that every path is taken."""

import bisect
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from parcelmill.llm import queries
from parcelmill.llm import quantile_summaries as q


def held(got, groups, parts=10, error=0.05, points=400):
    """Every row against its group's sorted values; groups: (group..., batch) to values, batch -1 included."""
    last = {}
    want = {k: sorted(v) for k, v in groups.items() if len(v) >= 20}
    assert len(got) == len({(r[0], r[1], r["batch"], r["i"]) for r in got}) == (parts - 1) * len(want)
    for r in sorted(got, key=lambda r: (str(r[0]), str(r[1]), r["batch"], r["i"])):
        key = (r[0], r[1], r["batch"])
        xs = want[key]
        n, distinct = len(xs), len(set(xs))
        assert r["n"] == n and r["target"] == -(-r["i"] * n // parts)
        assert r["exact_x"] == xs[r["target"] - 1]
        assert (r["n_below"], r["n_upto"]) == (bisect.bisect_left(xs, r["answer"]), bisect.bisect_right(xs, r["answer"]))
        assert r["rank_error"] == max(0, r["n_below"] + 1 - r["target"], r["target"] - r["n_upto"])
        assert r["within"] and r["rank_error"] <= error * n
        assert min(4, distinct) <= r["points"] <= min(distinct, points)
        assert xs[0] <= r["answer"] <= xs[-1] and last.get(key, r["answer"]) <= r["answer"]
        last[key] = r["answer"]


def spread(spark, rows):
    """rows: (stream, grp, batch, x), in uneven partitions; their groups with batch -1."""
    groups = defaultdict(list)
    for s, g, b, x in rows:
        groups[s, g, b].append(x)
        groups[s, g, -1].append(x)
    df = spark.createDataFrame(rows, "stream string, grp string, batch int, x long").repartition(3)
    return q.counted(df, ["stream", "grp", "batch"]), groups


@pytest.mark.parametrize("window_bits, kept_whole, radix_bits", [(16, 100, 7), (4, 10, 3), (20, 0, 5)])
def test_summaries_of_many_shapes(spark, monkeypatch, window_bits, kept_whole, radix_bits):
    for name, value in (("WINDOW_BITS", window_bits), ("KEPT_WHOLE", kept_whole), ("RADIX_BITS", radix_bits)):
        monkeypatch.setattr(q, name, value)
    rng = random.Random(window_bits)
    rows = []
    shapes = {
        "even": lambda: rng.randint(-5000, 5000), "heavy": lambda: 0 if rng.random() < 0.97 else rng.randint(10**6, 10**6 + 300), "tail": lambda: int(math.exp(rng.random() * 30)),
        "few": lambda: rng.randint(1, 3), "ends": lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 0, rng.randint(-9, 9)]), "one": lambda: 7,
    }
    for name, make in shapes.items():
        rows += [("v", name, rng.randint(0, 7), make()) for _ in range(2500)]
    rows += [(None, None, 0, rng.randint(0, 99)) for _ in range(60)] + [("v", "small", 3, x) for x in range(19)]
    values, groups = spread(spark, rows)
    held(q.judged(values, ["stream", "grp"], "batch", 10, 20, 0.05).collect(), groups)


def test_no_summary_sees_more_than_its_points(spark):
    """A merged summary is made from points alone: bounds hold for every value, and points are bounded."""
    rng = np.random.default_rng(5)
    rows = [("v", "g", int(b), int(x)) for b, x in zip(rng.integers(0, 8, 30_000), rng.integers(0, 10**6, 30_000), strict=True)]
    values, groups = spread(spark, rows)
    keys = ["stream", "grp", "batch"]
    stats = values.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    own = q.summarise(q.measured(values, keys, stats), keys)
    merged = q.merge(own, ["stream", "grp"]).first()
    xs = sorted(groups["v", "g", -1])
    assert 4 <= len(merged["points"]) <= 400 and merged["n"] == len(xs)
    for p in merged["points"]:
        assert p["below_lo"] <= bisect.bisect_left(xs, p["x"]) <= p["below_hi"]
        assert p["upto_lo"] <= bisect.bisect_right(xs, p["x"]) <= p["upto_hi"]
    # Merging what was merged already keeps to the bounds also.
    twice = q.merge(own.where("batch < 4").groupBy("stream", "grp", "batch").agg(F.first("n").alias("n"), F.first("points").alias("points")), ["stream", "grp"])
    again = q.merge(twice.unionByName(q.merge(own.where("batch >= 4"), ["stream", "grp"])), ["stream", "grp"]).first()
    for p in again["points"]:
        assert p["below_lo"] <= bisect.bisect_left(xs, p["x"]) <= p["below_hi"]


def test_thinning_keeps_both_ends_and_steps_of_rank():
    upto = np.cumsum(np.random.default_rng(2).integers(1, 50, 5000))
    at = q.thinned(upto, int(upto[-1]))
    assert at[0] == 0 and at[-1] == 4999 and len(at) <= q.MOST_POINTS
    gaps = np.diff(upto[at])
    assert gaps.max() <= upto[-1] / q.RANK_STEPS + 50


def test_the_query_against_plain_counting(spark):
    groups = defaultdict(list)
    clicks = spark.read.parquet(f"{SF}/clicks.parquet").dropDuplicates(["click_id"]).collect()
    prices = {r["item_id"]: r for r in spark.read.parquet(f"{SF}/items.parquet").collect()}
    found = [("value", str(r["client_id"]), r["click_id"], r["value"]) for r in clicks if r["client_id"] is not None and r["value"] is not None]
    for r in spark.read.parquet(f"{SF}/sale_lines.parquet").collect():
        item = prices.get(r["item_id"])
        if item is not None and item["brand"] is not None and item["price"] is not None:
            found.append(("price", item["brand"], r["vendor_id"], item["price"]))
    for stream, grp, i, money in found:
        batch = zlib.crc32(str(i).encode()) % 8
        x = math.floor(100 * money + 0.5) + 1000 * batch
        groups[stream, grp, batch].append(x)
        groups[stream, grp, -1].append(x)
    held(queries.op11_quantile_summaries(spark, SF).collect(), groups)


def test_empty_tables_and_odd_money(spark, tmp_path):
    """Money that is missing or not finite drops a row; equal clicks are one; a missing vendor is in batch 0."""
    spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, 5, None), (3, None, 1.0), (4, 5, float("nan")), (5, 5, float("inf"))] + [(i, 6, i / 7) for i in range(100, 140)], "click_id long, client_id long, value double").write.parquet(str(tmp_path / "clicks.parquet"))
    spark.createDataFrame([(1, None)] * 30 + [(None, 1), (9, 1)], "item_id long, vendor_id long").write.parquet(str(tmp_path / "sale_lines.parquet"))
    spark.createDataFrame([(1, "b", 2.5), (2, None, 1.0)], "item_id long, brand string, price double").write.parquet(str(tmp_path / "items.parquet"))
    got = queries.op11_quantile_summaries(spark, str(tmp_path)).collect()
    assert {(r["stream"], r["grp"], r["batch"], r["n"]) for r in got} == {("value", "6", -1, 40), ("price", "b", 0, 30), ("price", "b", -1, 30)}
    empty = tmp_path / "empty"
    for t in ("clicks", "sale_lines", "items"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert queries.op11_quantile_summaries(spark, str(empty)).count() == 0
