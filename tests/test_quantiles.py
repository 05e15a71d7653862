"""Exact quantiles by selection against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.operators import quantiles, stats


@pytest.mark.parametrize("shape, parts", [("even", 3), ("wide", 256), ("heavy", 256), ("few", 256)])
def test_quantiles_equal_sorting(spark, monkeypatch, shape, parts):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = random.Random(shape)
    make = {"even": lambda: rng.uniform(-5, 5), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 307), "heavy": lambda: 1.0 if rng.random() < 0.9 else rng.uniform(0, 2), "few": lambda: float(rng.randint(1, 3))}[shape]
    values = [make() for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    assert quantiles.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.quantiles(df, "v", (0.5,)) == [None] and quantiles.ranked_values(df, "v", [0]) == {}
    assert stats.describe(df.where("v IS NULL"), "v").first()["p50"] is None


def test_no_task_holds_all_values(spark):
    found = stats.describe(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v")
    assert "percentile" not in found._jdf.queryExecution().toString().lower() and found.first()["p25"] == 249.75
