"""Price models on MLlib, cross-validation over contiguous folds, parameter tests, and spatial errors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import contiguous_folds
from ..operators import stats
from ..sources.shared import shared_folder
from . import trees

#: Parameters of the models.  Trees stop at depth 30, the most that MLlib has.
RIDGE_ALPHA = 0.1
BOOSTED = {"lossType": "absolute", "maxIter": 3000, "stepSize": 0.01, "subsamplingRate": 0.5, "maxDepth": 30}
FOREST = {"numTrees": 100, "maxDepth": 30}
WORST_SCORE = -(10**6)
FOLDS_AT_ONCE = 5
#: Rows of a partition that tree learners are given.
PART_ROWS = 100_000

Fitter = Callable[[DataFrame, str, str], object]


class BadScoreError(RuntimeError):
    """A score that shows the model cannot be told from the data."""


def ols(table: DataFrame, features: str, y: str):
    return LinearRegression(featuresCol=features, labelCol=y, regParam=0.0, solver="normal").fit(table)


def ridge(table: DataFrame, features: str, y: str, alpha: float = RIDGE_ALPHA):
    """Ridge with the penalty on raw coefficients: MLlib scales its penalty by rows and the target's deviation."""
    s = table.agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s"), F.stddev_samp(y).alias("t")).first()
    strength = alpha / s["n"] * (s["s"] or 1.0) if s["n"] else 0.0
    return LinearRegression(featuresCol=features, labelCol=y, elasticNetParam=0.0, standardization=False, solver="normal", regParam=strength).fit(table)


def dealt(table: DataFrame, features: str, y: str, most_rows: int | None = None) -> DataFrame:
    """The features and target in partitions of about most_rows rows (PART_ROWS) at most.

    MLlib's trees keep each partition as one block that a task reads whole in every pass, and a file of few row groups is
    read as few partitions, however many rows it has.  Rows are sorted inside partitions, as trees are bagged by place: a
    task that runs again draws the same.  A table of at most most_rows rows stays as it is.
    """
    most_rows = most_rows or PART_ROWS
    n = table.count()
    if n <= most_rows:
        return table
    order = [F.col(f"`{y}`"), vector_to_array(F.col(features))]
    return table.select(features, f"`{y}`").repartition(-(-n // most_rows)).sortWithinPartitions(*order)


def boosted(table: DataFrame, features: str, y: str, **params):
    """Gradient boosting on absolute errors.  Each tree's errors come of those before: MLlib cuts that chain every ten
    trees, but only where there is a folder for checkpoints."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(table.sparkSession))
    return GBTRegressor(featuresCol=features, labelCol=y, seed=1, **{**BOOSTED, **params}).fit(dealt(table, features, y))


def forest(table: DataFrame, features: str, y: str, **params):
    return RandomForestRegressor(featuresCol=features, labelCol=y, seed=1, **{**FOREST, **params}).fit(dealt(table, features, y))


def _trees(fit: Callable[..., trees.TreeModel]) -> Fitter:
    """A fitter of trees over the vector column, with the parameters given (the fixed ones by default)."""
    return lambda table, features, y, **params: fit(table, features, y, **params)


MODELS: dict[str, Fitter] = {
    "ols": ols, "ridge": ridge, "boosted": boosted, "forest": forest,
    "second_order": _trees(trees.boosted_trees), "extra_trees": _trees(trees.extra_trees), "bagged": _trees(trees.bagged_forest),
}


def assembled(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with a features vector; rows with a missing feature are left out."""
    safe = {c: f"_x{i}" for i, c in enumerate(columns)}
    named = table.withColumns({s: F.col(f"`{c}`").cast("double") for c, s in safe.items()})
    return VectorAssembler(inputCols=list(safe.values()), outputCol="features", handleInvalid="skip").transform(named).drop(*safe.values())


def cross_validate(table: DataFrame, columns: Sequence[str], y: str, fit: Fitter, folds: int = 5, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold estimates (row_id, fold, y, estimate), and score and mean absolute error by fold.

    One fold means the first of five.  A missing or absurd score is an error, as are rows without an estimate.
    """
    wanted = 1 if folds == 1 else folds
    rows = contiguous_folds(assembled(table, columns), row_id, 5 if folds == 1 else folds).cache()
    rows.count()
    # Folds are fitted at the same time: one fit alone seldom fills a cluster.
    with ThreadPool(min(wanted, FOLDS_AT_ONCE)) as pool:
        fitted = pool.map(inheritable_thread_target(table.sparkSession)(lambda i: fit(rows.where(F.col("fold") != i), "features", y)), range(wanted))
    found = None
    for i, model in enumerate(fitted):
        part = model.transform(rows.where(F.col("fold") == i)).select(row_id, "fold", F.col(y).alias("y"), F.col("prediction").alias("estimate"))
        found = part if found is None else found.unionByName(part)
    scores = stats.r2(found, "y", "estimate", by=["fold"]).join(found.groupBy("fold").agg(stats.mae(F.col("y"), F.col("estimate")).alias("mae")), "fold")
    for r in scores.collect():
        if r["r2"] is None or r["r2"] != r["r2"] or r["r2"] < WORST_SCORE:
            raise BadScoreError(f"fold {r['fold']} scored {r['r2']}")
    if wanted > 1:
        # Every fold's rows are estimated or not: counts tell, and no ids have to meet.
        missing = rows.count() - found.where(F.col(row_id).isNotNull() & F.col("estimate").isNotNull()).count()
        if missing:
            raise RuntimeError(f"{missing} rows have no estimate")
    return found, scores


def estimation_table(estimates: DataFrame) -> DataFrame:
    """Actual, estimate and error of every row."""
    return estimates.select("row_id", F.col("y").alias("actuals"), F.col("estimate").alias("cv_estimates"), (F.col("estimate") - F.col("y")).alias("cv_errors"))


def test_params(table: DataFrame, columns: Sequence[str], y: str, fit: Callable[..., object], base: Mapping, grid: Sequence[Mapping], folds: int = 5) -> DataFrame:
    """Scores of every change to the base parameters: params map, scores array."""
    rows = []
    for change in grid:
        params = {**base, **change}
        _, scores = cross_validate(table, columns, y, lambda t, f, target, p=params: fit(t, f, target, **p), folds)
        rows.append(({k: str(v) for k, v in params.items()}, [r["r2"] for r in scores.orderBy("fold").collect()]))
    return table.sparkSession.createDataFrame(rows, "params map<string,string>, scores array<double>")


def best_by_search(table: DataFrame, columns: Sequence[str], y: str, fit: Callable[..., object], grid: Sequence[Mapping], folds: int = 3) -> tuple[dict, float]:
    """The grid point with the least mean squared error over the folds."""
    best = None
    for params in grid:
        found, _ = cross_validate(table, columns, y, lambda t, f, target, p=params: fit(t, f, target, **p), folds)
        error = found.agg(stats.mse(F.col("y"), F.col("estimate"))).first()[0]
        if best is None or error < best[1]:
            best = (dict(params), error)
    return best


def coefficient_table(spark, columns: Sequence[str], model) -> DataFrame:
    """Coefficients by column, the intercept first."""
    values = [("intercept", float(model.intercept)), *[(c, float(v)) for c, v in zip(columns, model.coefficients, strict=True)]]
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "place int, feature string, coefficient double")


def importance_table(spark, columns: Sequence[str], model) -> DataFrame:
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def score_log_rows(results: DataFrame) -> DataFrame:
    """Parameter test results as log rows: parameters in name order, scores joined by semicolons."""
    params = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return results.select(params.alias("params"), F.concat_ws(";", F.transform("scores", lambda s: F.format_string("%.6f", s))).alias("scores"))


def spatial_error_fit(table: DataFrame, columns: Sequence[str], y: str, weights: DataFrame, key: str = "row_id", most_rows: int = 4000):
    """Maximum likelihood of y = c + Xb + u, u = lambda W u + e, over row-standardised weights (i, j, w).

    The likelihood needs the determinant of a full matrix, so this is for samples of at most most_rows rows.  Returns
    intercept, coefficients and lambda; predictions use the intercept and coefficients alone.
    """
    import numpy as np

    pdf = table.select(key, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(y).cast("double").alias("y")).orderBy(key).limit(most_rows + 1).toPandas()
    if len(pdf) > most_rows:
        raise ValueError(f"more than {most_rows} rows: draw a sample first")
    place = {k: i for i, k in enumerate(pdf[key])}
    w = np.zeros((len(pdf), len(pdf)))
    for r in weights.join(table.select(F.col(key).alias("i")), "i", "left_semi").toLocalIterator():
        if r["i"] in place and r["j"] in place:
            w[place[r["i"]], place[r["j"]]] = r["w"]
    sums = w.sum(1, keepdims=True)
    w = np.divide(w, sums, out=np.zeros_like(w), where=sums > 0)
    x = np.column_stack([np.ones(len(pdf)), pdf[[f"x{i}" for i in range(len(columns))]].to_numpy()])
    target = pdf["y"].to_numpy()
    roots = np.linalg.eigvals(w)

    def at(lam):
        xs, ys = x - lam * (w @ x), target - lam * (w @ target)
        beta, *_ = np.linalg.lstsq(xs, ys, rcond=None)
        variance = ((ys - xs @ beta) ** 2).mean()
        return -len(target) / 2 * np.log(variance) + np.log(np.abs(1 - lam * roots)).sum(), beta

    # The likelihood has one peak: golden section search.
    lo, hi, g = -0.99, 0.99, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if at(a)[0] > at(b)[0] else (a, hi)
    lam = (lo + hi) / 2
    beta = at(lam)[1]
    return float(beta[0]), [float(v) for v in beta[1:]], float(lam)


def predict_linear(table: DataFrame, columns: Sequence[str], intercept: float, coefficients: Sequence[float], name: str = "estimate") -> DataFrame:
    total = F.lit(intercept)
    for c, b in zip(columns, coefficients, strict=True):
        total = total + F.lit(float(b)) * F.col(f"`{c}`")
    return table.withColumn(name, total)
