"""The spatial fit by edges and probes against the dense solver."""

import numpy as np
import pytest

from parcelmill.plans import models, spatial


def points(n, lam, seed=1, k=8):
    rng = np.random.default_rng(seed)
    at = rng.uniform(size=(n, 2))
    near = np.argsort(((at[:, None] - at[None]) ** 2).sum(-1), axis=1)[:, 1 : k + 1]
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = 1 / k
    x = rng.normal(size=(n, 2))
    y = 5 + x @ [2.0, -1.0] + np.linalg.solve(np.eye(n) - lam * w, rng.normal(size=n))
    return x, y, [(i, int(j), 2.0) for i in range(n) for j in near[i]], w


def frames(spark, x, y, edges):
    table = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "row_id long, a double, `b.x` double, y double").repartition(3)
    return table, spark.createDataFrame(edges, "i long, j long, w double")


def test_agrees_with_the_dense_solver(spark):
    x, y, edges, _ = points(2000, 0.5)
    table, weights = frames(spark, x, y, edges)
    intercept, slopes, lam = models.spatial_error_fit(table, ["a", "b.x"], "y", weights)
    fit = spatial.spatial_error_fit(table, ["a", "b.x"], "y", weights, probes=256)
    assert fit.rows == 2000 and fit.lam == pytest.approx(lam, abs=1e-3)
    assert [fit.intercept, *fit.coefficients] == pytest.approx([intercept, *slopes], abs=1e-3)


def test_traces_and_log_determinant(spark):
    _, _, edges, w = points(300, 0.3, 2)
    ids = spark.range(300).withColumnRenamed("id", "i")
    held = spatial.standardised(spark.createDataFrame([*edges, (0, 999, 5.0), (999, 0, 5.0)], "i long, j long, w double"), ids)
    found = spatial.traces(held, ids, probes=400, powers=8)
    exact = [np.trace(np.linalg.matrix_power(w, k)) for k in range(1, 9)]
    assert found[:2] == pytest.approx(exact[:2], abs=1e-9) and found[2:] == pytest.approx(exact[2:], rel=0.12, abs=0.6)
    many = [np.trace(np.linalg.matrix_power(w, k)) for k in range(1, 15)]
    for lam in (-0.8, 0.2, 0.6, 0.9):
        assert spatial.log_determinant(lam, many) == pytest.approx(np.linalg.slogdet(np.eye(300) - lam * w)[1], abs=0.35)


def test_probes_do_not_depend_on_partitions(spark):
    x, y, edges, _ = points(200, 0.4, 3)
    table, weights = frames(spark, x, y, edges)
    one = spatial.spatial_error_fit(table, ["a"], "y", weights, powers=5)
    other = spatial.spatial_error_fit(table.repartition(7), ["a"], "y", weights.repartition(5), powers=5)
    assert one.lam == pytest.approx(other.lam, abs=1e-6) and one.coefficients == pytest.approx(other.coefficients, abs=1e-6)


def test_odd_rows(spark):
    """Missing values leave out their rows and edges; rows without neighbours stay; no rows is an error."""
    x, y, edges, _ = points(60, 0.2, 4)
    table, weights = frames(spark, x, y, edges)
    extra = spark.createDataFrame([(900, None, 1.0, 1.0), (901, 1.0, float("nan"), 1.0), (902, 0.5, 0.5, 5.0)], table.schema)
    more = weights.unionByName(spark.createDataFrame([(900, 1, 1.0), (1, 901, 1.0)], weights.schema))
    fit = spatial.spatial_error_fit(table.unionByName(extra), ["a", "b.x"], "y", more, powers=4)
    assert fit.rows == 61 and abs(fit.lam) < 1
    with pytest.raises(ValueError):
        spatial.spatial_error_fit(table.limit(0), ["a"], "y", weights)
