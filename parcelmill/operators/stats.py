"""Counts, pivots, exact summaries, error roll-ups and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import cap
from .islands import duplicate_groups
from .quantiles import quantiles

#: The pivots of the feature report (row, column, cap) and its counts.
FEATURE_PIVOTS = (("property_type", "bedrooms", 8), ("suburb", "bedrooms", 8), ("suburb", "property_type", None))
FEATURE_COUNTS = ("suburb", "property_type")

# Upper bounds of map colours, by what is drawn and for which property types.
SALES_HIGH = (200_000, 400_000, 600_000, 700_000, 800_000, 1_000_000, 1_500_000)
SALES_LOW = (0, 200_000, 300_000, 400_000, 500_000, 600_000, 800_000)
RENTALS_HIGH = (400, 500, 600, 700, 800, 1000, 1200)
RENTALS_LOW = (250, 300, 400, 500, 600, 800, 1000)
YIELDS = (0.01, 0.03, 0.04, 0.045, 0.05, 0.055, 0.06, 0.07, 1)
LOW_TYPES = ("Unit", "Town House", "Studio")


def map_breaks(kind: str, property_type: str) -> tuple:
    """The bounds for sales, rentals or yields of a property type."""
    if kind == "yields":
        return YIELDS
    low = property_type in LOW_TYPES
    if kind == "sales":
        return SALES_LOW if low else SALES_HIGH
    if kind == "rentals":
        return RENTALS_LOW if low else RENTALS_HIGH
    raise ValueError(f"unknown kind {kind}")


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group; groups with a missing key are left out."""
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, by: str) -> DataFrame:
    return count_by(df, by).orderBy(F.desc("n"), by)


def capped_count_by(df: DataFrame, caps: dict[str, int | None]) -> DataFrame:
    """Rows per group, values above their column's cap counted with it."""
    return count_by(df.select(*[(cap(F.col(c), m) if m is not None else F.col(c)).alias(c) for c, m in caps.items()]), *caps)


def levels(df: DataFrame, column: str) -> list:
    """Sorted distinct values without the missing one."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def pivot_count(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Count table of two columns; absent pairs count 0, and missing keys are left out."""
    values = levels(df, columns) if values is None else list(values)
    kept = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return kept.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(str(v)) for v in values])


def capped_pivot_count(df: DataFrame, rows: str, columns: str, most: int) -> DataFrame:
    """pivot_count with values above the cap counted with it; the last column is named as open above."""
    capped = df.select(rows, cap(F.col(columns), most).alias(columns))
    table = pivot_count(capped, rows, columns)
    return table.withColumnRenamed(table.columns[-1], f"{table.columns[-1]}+") if len(table.columns) > 1 else table


def feature_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The feature report's tables by name."""
    found = {f"{a}_{b}": pivot_count(df, a, b) if most is None else capped_pivot_count(df, a, b, most) for a, b, most in FEATURE_PIVOTS}
    return found | {f"{c}_count": value_counts(df, c) for c in FEATURE_COUNTS}


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact linear quartiles (by selection), in one row."""
    c, shares = F.col(column), (0.25, 0.5, 0.75)
    quartiles = [F.lit(v).cast("double").alias(f"p{int(100 * p)}") for p, v in zip(shares, quantiles(df, column, shares), strict=True)]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), *quartiles, F.max(c).alias("most"))


def filtered_ratio(df: DataFrame, kept: Column) -> DataFrame:
    """All rows, rows that pass, and their ratio."""
    return df.agg(F.count("*").alias("rows"), F.count_if(kept).alias("kept"), F.try_divide(F.count_if(kept), F.count("*")).alias("ratio"))


def distinct_count(column: str, missing_counts: bool = False) -> Column:
    found = F.countDistinct(column)
    return found + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0)) if missing_counts else found


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def mean_error_by(df: DataFrame, when: str, error: Column, period: str) -> DataFrame:
    """Mean absolute error by day, ISO week (with the calendar year and month) or month."""
    parts = {"year": F.year(when), "month": F.month(when)}
    if period == "day":
        parts["day"] = F.dayofmonth(when)
    elif period == "week":
        parts["week"] = F.weekofyear(when)
    elif period != "month":
        raise ValueError(f"unknown period {period}")
    return df.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.avg(F.abs(error)).alias("mean_error"))


def normalised_error(error: Column, actual: Column) -> Column:
    return F.abs(F.try_divide(error, actual))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) ** 2)


def huber_sum(y: Column, p: Column, delta: float = 0.5) -> Column:
    """Sum of half squares up to delta, and of straight lines beyond it."""
    e = F.abs(y - p)
    return F.sum(F.when(e < delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def r2(df: DataFrame, y: str, p: str, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    """Coefficient of determination, per group; epsilon is added to the total sum of squares."""
    y_, p_ = F.col(y), F.col(p)
    # n * population variance is the total sum of squares.
    total = F.count(y_) * F.var_pop(y_) + epsilon
    return df.groupBy(*by).agg((1 - F.try_divide(F.sum((y_ - p_) ** 2), total)).alias("r2"))


def unscaled(c: Column, mean: float, scale: float) -> Column:
    return c * scale + mean


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0)."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("scale", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_scale") == 0, 1.0).otherwise(F.col(f"{c}_scale")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def mean_scores(results: DataFrame) -> DataFrame:
    """Mean of each parameter set's scores (params map, scores array)."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return results.withColumn("mean_score", F.try_divide(total, F.size("scores")))


def score_lines(results: DataFrame, along: str) -> DataFrame:
    """One line per combination of the other parameters: (value, mean score) along one parameter, by value."""
    scored = mean_scores(results)
    others = F.map_filter("params", lambda k, _: k != along)
    keyed = scored.withColumn("others", F.array_sort(F.map_entries(others))).withColumn("value", F.col("params")[along])
    return keyed.groupBy("others").agg(F.array_sort(F.collect_list(F.struct("value", "mean_score"))).alias("line"))


def best_params(results: DataFrame) -> DataFrame:
    """The parameter set with the highest mean score."""
    return mean_scores(results).agg(F.max_by(F.struct("params", "mean_score"), "mean_score").alias("best")).select("best.*")


def axis_limits(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.least(F.min(x), F.min(y)).alias("low"), F.greatest(F.max(x), F.max(y)).alias("high"))


def kernel_density(df: DataFrame, column: str, points: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """Gaussian density at evenly spaced points, bandwidth by Scott's rule; x and density.

    Values are first counted in bins a fiftieth of the bandwidth wide, so the grid meets bins, not rows.
    """
    s = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if not s["n"] or not s["std"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = s["std"] * s["n"] ** -0.2
    step = width / 50
    low, high = s["low"] if low is None else low, s["high"] if high is None else high
    bins = df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / step).alias("bin")).agg(F.count("*").alias("n"), F.avg(column).alias("at"))
    grid = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / max(points - 1, 1))).alias("x"))
    z = (F.col("x") - F.col("at")) / width
    # Bins beyond six bandwidths add nothing that shows; the join keeps near ones by cell.
    cell = 6 * width
    near = grid.withColumn("cell", F.explode(F.array(*[F.floor(F.col("x") / cell) + i for i in (-1, 0, 1)])))
    met = near.join(bins.withColumn("cell", F.floor(F.col("at") / cell)), "cell", "left")
    height = F.coalesce(F.sum(F.col("n") * F.exp(-z * z / 2)), F.lit(0.0)) / (s["n"] * width * (2 * 3.141592653589793) ** 0.5)
    return met.groupBy("x").agg(height.alias("density"))


def bin_of(c: Column, breaks: Sequence[float], missing: int = -1) -> Column:
    """Index of the first break at or above the value; past the last, their number; `missing` for no value."""
    if list(breaks) != sorted(breaks):
        raise ValueError(f"breaks are not in ascending order: {breaks}")
    found = F.when(c.isNull(), F.lit(missing))
    for i, b in enumerate(breaks):
        found = found.when(c <= b, F.lit(i))
    return found.otherwise(F.lit(len(breaks)))


def bin_counts(df: DataFrame, column: str, breaks: Sequence[float]) -> DataFrame:
    """Rows of every bin, empty ones included; bin -1 counts missing values."""
    every = df.sparkSession.range(-1, len(breaks) + 1).select(F.col("id").cast("int").alias("bin"))
    counts = df.groupBy(bin_of(F.col(column), breaks).alias("bin")).agg(F.count("*").alias("n"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def error_points(df: DataFrame, when: str, error: Column) -> DataFrame:
    """Date and error of every row that has both."""
    return df.select(F.col(when).alias("at"), error.alias("error")).where("at is not null and error is not null")


def scatter_groups(df: DataFrame, feature: str, x: str, y: str, cap_at: int | None = None) -> DataFrame:
    """Points (x, y) with the feature's group: its values, numbers above the cap together."""
    group = F.col(feature) if cap_at is None else cap(F.col(feature), cap_at)
    return df.select(group.alias("panel"), F.col(x).alias("x"), F.col(y).alias("y")).where("panel is not null")


def duplicates_report(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return duplicate_groups(df, by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
