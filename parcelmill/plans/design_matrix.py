"""Design matrices from a declarative feature spec.

A spec is an ordered list of (columns, kind); kinds are continuous, categorical, ordinal, polynomial,
numerically_encoded, time_sequence and linear_by_categorical (a pair: number, category).  The matrix keeps row_id, and
its columns come in a fixed order: base columns, powers, interactions, then dummies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import dense_index
from ..operators import filters
from ..operators.islands import check_and_unduplicate
from ..operators.stats import levels

# The default spec, levels without a dummy, limits of ordinals, degree, fills, the epoch.
DEFAULT_SPEC = [
    (("bedrooms",), "continuous"),
    (("garage_spaces",), "continuous"),
    (("bathrooms",), "continuous"),
    (("X",), "continuous"),
    (("Y",), "continuous"),
    (("property_type",), "categorical"),
]
EXCLUDED_LEVELS = {"property_type": "Not Specified", "suburb": "not specified", "bedrooms": 0, "bathrooms": 0, "garage_spaces": 0}
ORDINAL_EXCLUDED, ORDINAL_MOST = 1, 8
DEGREE = 3
FILLED, FILL = ("bathrooms", "bedrooms", "garage_spaces"), -1
EPOCH = "2017-11-09"
KINDS = ("continuous", "categorical", "ordinal", "polynomial", "numerically_encoded", "time_sequence", "linear_by_categorical")

Spec = Sequence[tuple[tuple[str, ...], str]]


@dataclass
class DesignMatrix:
    """X and y in one table, the names of X's columns in order, and the positions of its groups."""

    table: DataFrame
    columns: list[str]
    y: str
    categorical_groups: list[tuple[str, int, int]] = field(default_factory=list)
    interaction_groups: list[tuple[str, str, int, int]] = field(default_factory=list)
    encoded_columns: list[tuple[str, int]] = field(default_factory=list)
    encoders: dict[str, list[str]] = field(default_factory=dict)

    def shape(self) -> tuple[int, int]:
        return self.table.count(), len(self.columns)


def of_kind(spec: Spec, *kinds: str) -> list[tuple[str, ...]]:
    return [c for c, k in spec if k in kinds]


def check_spec(spec: Spec) -> None:
    """Known kinds, and nothing but categoricals after the first of them."""
    unknown = [k for _, k in spec if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown kinds of features: {unknown}")
    seen = False
    for _, kind in spec:
        if seen and kind != "categorical":
            raise RuntimeError("categoricals must come last in a spec")
        seen = seen or kind == "categorical"


def level_name(value) -> str:
    """Levels in column names: whole numbers without a fraction."""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def excluded(column: str) -> Column:
    """The category with its excluded level as missing."""
    return F.nullif(F.col(column), F.lit(EXCLUDED_LEVELS[column])) if column in EXCLUDED_LEVELS else F.col(column)


def ordinal(column: str) -> Column:
    c = F.col(column)
    return F.when(c == ORDINAL_EXCLUDED, F.lit(None)).when(c > ORDINAL_MOST, F.lit(ORDINAL_MOST)).otherwise(c)


def powers(column: str) -> dict[str, Column]:
    if DEGREE != 3:
        raise ValueError("only polynomials of degree 3 are supported")
    return {f"{column}_^2": F.col(column) ** 2, f"{column}_^3": F.col(column) ** 3}


def dummy(value: Column, level) -> Column:
    return F.coalesce((value == level).cast("int"), F.lit(0))


def interaction(value: Column, level, number: str) -> Column:
    """The number where the category has the level, else 0; missing numbers stay missing on every level."""
    return dummy(value, level) * F.col(number)


def days_since_epoch(column: str) -> Column:
    return F.datediff(F.col(column), F.lit(EPOCH).cast("date"))


def encoder(df: DataFrame, column: str) -> list[str]:
    """Sorted texts of a column; a value's code is its place."""
    return [r[0] for r in df.select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("v")).distinct().orderBy("v").collect()]


#: Levels that are broadcast; more are joined.
BROADCAST_LEVELS = 10_000


def level_table(df: DataFrame, column: str) -> DataFrame:
    """value and code of each text of a column, in order from 0, the missing one as "None": encoder() as a table, for any
    number of levels."""
    values = df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("None")).alias("value")).distinct()
    return dense_index(values, "value", "code")


def _joined(df: DataFrame, levels: DataFrame, on: Column, side: str, made: str, name: str) -> DataFrame:
    table = levels.select(F.col(side).alias("_on"), F.col(made).alias("_made"))
    if levels.limit(BROADCAST_LEVELS + 1).count() <= BROADCAST_LEVELS:
        table = F.broadcast(table)
    return df.join(table, on == F.col("_on"), "left").withColumn(name, F.col("_made")).drop("_on", "_made")


def encode_joined(df: DataFrame, column: str, levels: DataFrame, name: str) -> DataFrame:
    """df with the code of a column's text; null for one that the levels do not hold."""
    return _joined(df, levels, F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("None")), "value", "code", name)


def decode_joined(df: DataFrame, code: str, levels: DataFrame, name: str) -> DataFrame:
    """df with the text of a code; null for one that the levels do not hold."""
    return _joined(df, levels, F.col(f"`{code}`"), "code", "value", name)


def encode(column: Column, values: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.coalesce(column.cast("string"), F.lit("None"))) - 1


def decode(code: Column, values: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (code + 1).cast("int"))


def target() -> Column:
    """Mean of the two prices, or the one there is."""
    low, high = F.col("price_min"), F.col("price_max")
    return F.coalesce((low + high) / 2, low, high)


def build(df: DataFrame, spec: Spec = DEFAULT_SPEC, y: Column | None = None, row_id: str = "row_id") -> DesignMatrix:
    """X and y of prepared rows.  Levels are collected once, and all columns come from one select."""
    check_spec(spec)
    single = [c[0] for c, k in spec if k != "linear_by_categorical"]
    replaced = {c[0]: excluded(c[0]) for c in of_kind(spec, "categorical")} | {c[0]: ordinal(c[0]) for c in of_kind(spec, "ordinal")}
    prepared = df.withColumns(replaced) if replaced else df
    dummies = [c[0] for c in of_kind(spec, "categorical", "ordinal")]
    pairs = of_kind(spec, "linear_by_categorical")
    level_of = {c: levels(prepared, c) for c in dict.fromkeys([*dummies, *[p[1] for p in pairs]])}
    encoders = {c[0]: encoder(prepared, c[0]) for c in of_kind(spec, "numerically_encoded")}
    timed = {c[0] for c in of_kind(spec, "time_sequence")}

    chosen: dict[str, Column] = {}
    for c in single:
        if c not in dummies:
            chosen[c] = encode(F.col(c), encoders[c]) if c in encoders else days_since_epoch(c) if c in timed else F.col(c)
    for (c,) in of_kind(spec, "polynomial"):
        chosen |= powers(c)
    interaction_groups, categorical_groups = [], []
    for number, category in pairs:
        at = len(chosen)
        chosen |= {f"{number}_by_{level_name(v)}": interaction(F.col(category), v, number) for v in level_of[category]}
        interaction_groups.append((number, category, at, len(chosen)))
    for c in dummies:
        at = len(chosen)
        chosen |= {f"{c}_{level_name(v)}": dummy(F.col(c), v) for v in level_of[c]}
        categorical_groups.append((c, at, len(chosen)))
    kept = [F.col(row_id)] if row_id in df.columns else []
    table = prepared.select(*kept, *[v.alias(k) for k, v in chosen.items()], (target() if y is None else y).alias("y"))
    names = list(chosen)
    return DesignMatrix(table, names, "y", categorical_groups, interaction_groups, [(c, names.index(c)) for c in encoders], encoders)


def accepted(df: DataFrame, kind: str, geocoded: bool = True, least_suburb: int | None = None) -> DataFrame:
    """Rows that a model of sales or rentals is fitted on."""
    if kind not in ("sales", "rentals"):
        raise ValueError(f"unknown kind {kind}")
    sales = kind == "sales"
    df = df.where((filters.sale_kind() if sales else filters.rental_kind()) & filters.some_price())
    df = df.where(filters.price_in(filters.SALES_PRICES if sales else filters.RENTAL_PRICES) & filters.general_qc())
    if geocoded:
        df = df.where(F.coalesce(F.col("geocoding_is_valid"), F.lit(False)))
    return filters.min_population(df, "suburb", least_suburb) if least_suburb is not None else df


def qc_rejects(df: DataFrame, kind: str) -> DataFrame:
    """Rows that the price check turns away, missing prices included."""
    return df.where(filters.rejected(filters.price_in(filters.SALES_PRICES if kind == "sales" else filters.RENTAL_PRICES)))


def fill_counts(df: DataFrame) -> DataFrame:
    return df.na.fill(FILL, [c for c in FILLED if c in df.columns])


def design_matrix(df: DataFrame, kind: str, spec: Spec = DEFAULT_SPEC, merge: bool = True, geocoded: bool = True, least_suburb: int | None = None) -> DesignMatrix:
    """Filter, merge re-listed properties, fill missing counts, then build."""
    rows = accepted(df, kind, geocoded, least_suburb)
    if merge:
        rows = check_and_unduplicate(rows)
    return build(fill_counts(rows), spec)


def identifiable(matrix: DesignMatrix, rows: DataFrame | None = None) -> list[str]:
    """Columns whose coefficients can be told: not all 0; of a dummy group without an all-zero row not the last; and of
    interactions those with more than one value besides 0.  One aggregation finds all of it."""
    table = matrix.table if rows is None else rows
    aggs = [F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(0))).alias(f"s{i}") for i, c in enumerate(matrix.columns)]
    for g, (_, lo, hi) in enumerate(matrix.categorical_groups):
        total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in matrix.columns[lo:hi]], F.lit(0))
        aggs.append(F.max((total == 0).cast("int")).alias(f"g{g}"))
    inner = [i for _, _, lo, hi in matrix.interaction_groups for i in range(lo, hi)]
    aggs += [F.countDistinct(F.nullif(F.col(f"`{matrix.columns[i]}`"), F.lit(0))).alias(f"d{i}") for i in inner]
    found = table.agg(*aggs).first()
    dropped = {i for i in range(len(matrix.columns)) if not (found[f"s{i}"] or 0) > 0}
    dropped |= {hi - 1 for g, (_, lo, hi) in enumerate(matrix.categorical_groups) if hi > lo and not found[f"g{g}"]}
    dropped |= {i for i in inner if found[f"d{i}"] == 1}
    return [c for i, c in enumerate(matrix.columns) if i not in dropped]


def combinations(spark, comparisons: Sequence[tuple[Sequence[tuple[int, int, int]], Sequence[str], Sequence[str]]]) -> DataFrame:
    """Comparison rows: for every spec, the product of (bed, bath, garage) triples, property types and suburbs."""
    rows = [(*t, p, s) for triples, types, suburbs in comparisons for t, p, s in product(triples, types, suburbs)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, bedrooms int, bathrooms int, garage_spaces int, property_type string, suburb string")


def encode_like(rows: DataFrame, columns: Sequence[str], numbers: Sequence[str] = ("bedrooms", "bathrooms", "garage_spaces"), categories: Sequence[str] = ("property_type", "suburb")) -> DataFrame:
    """Comparison rows in the columns of a fitted matrix; columns they say nothing on are 0."""
    chosen = {c: F.lit(0) for c in columns}
    for n in numbers:
        for name, value in ((n, F.col(n)), (f"{n}_^2", F.col(n) ** 2), (f"{n}_^3", F.col(n) ** 3)):
            if name in chosen:
                chosen[name] = value
        for c in columns:
            if c.startswith(f"{n}_by_"):
                level = c[len(n) + 4 :]
                matches = reduce(lambda a, b: a | b, [F.coalesce(F.col(k) == level, F.lit(False)) for k in categories])
                chosen[c] = F.when(matches, F.col(n)).otherwise(F.lit(0))
    for k in categories:
        for c in columns:
            if c.startswith(f"{k}_"):
                chosen[c] = dummy(F.col(k), c[len(k) + 1 :])
    return rows.select("row_id", *[v.alias(c) for c, v in chosen.items()])


def surface_inputs(grid: DataFrame, property_type: Column, bedrooms: int, bathrooms: int, garage_spaces: int) -> DataFrame:
    """Grid points (X, Y) with one fixed property's features, powers included."""
    fixed = {"bedrooms": bedrooms, "garage_spaces": garage_spaces, "bathrooms": bathrooms}
    added = {n: F.lit(float(v)) for n, v in fixed.items()} | {"property_type": property_type}
    added |= {f"{n}_^{p}": F.lit(float(v) ** p) for n, v in fixed.items() for p in (2, 3)}
    return grid.withColumns(added)


def price_surface(inputs: DataFrame, predict, limits: tuple[float, float], estimate: str = "estimate") -> DataFrame:
    """Estimates over the grid, clamped to the limits.  predict adds the estimate column."""
    return predict(inputs).withColumn(estimate, filters.clamp(F.col(estimate), *limits))
