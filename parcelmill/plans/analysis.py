"""Whole analyses: quality summary, feature tables, model analysis, comparison estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, stats
from ..operators.islands import duplicate_groups, property_columns
from ..operators.records import full_extend
from ..sources.io import write_text
from . import models
from .design_matrix import DesignMatrix, Spec, accepted, combinations, design_matrix, encode_like, qc_rejects


def data_summary(df: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Counts and ratios before and after the filters, unbroken sequences, a summary of prices, and rejected rows."""
    kept = accepted(df, kind)
    n = df.count()
    counts = kept.agg(F.lit(n).alias("rows"), F.count("*").alias("kept"), F.try_divide(F.count("*"), F.lit(n)).alias("ratio"), F.count_if(~F.col("sequence_broken")).alias("unbroken"))
    return {"counts": counts, "prices": stats.describe(kept, "price_min"), "rejected": qc_rejects(df, kind)}


def summary_text(df: DataFrame, kind: str) -> str:
    """The summary's counts and ratios as a few lines of text."""
    counts = data_summary(df, kind)["counts"].first()
    n, open_rows = counts["rows"], df.where("sequence_broken = false").count()
    share = lambda k: k / n if n else float("nan")
    return f"Filtered from {n} to {counts['kept']} records, {share(counts['kept']):.2f} remaining\nUnbroken sequences, {open_rows} of {n} records, {share(open_rows):.2f}\n"


def qc_text(df: DataFrame, kind: str, most_rows: int = 20) -> str:
    """What the price check and the general check turn away: counts, and the first rows of each by row id."""
    lines, n = [], df.count()
    for name, rejected in (("Price filter", qc_rejects(df, kind)), ("General filter", df.where(filters.rejected(filters.general_qc())))):
        rows = rejected.orderBy("row_id").limit(most_rows).toPandas()
        lines.append(f"{name} - from {n} to {rejected.count()} records:\n{rows.to_string(index=False) if len(rows) else '(none)'}\n")
    return "\n".join(lines)


def write_reports(df: DataFrame, kind: str, folder: str) -> None:
    """The two texts as files of a local folder."""
    write_text(summary_text(df, kind), f"{folder}/data_notes.txt")
    write_text(qc_text(df, kind), f"{folder}/qc_data_filter_report.txt")


def broken_sequences(df: DataFrame, kind: str) -> DataFrame:
    """All listings of properties listed more than once."""
    kept = accepted(df, kind)
    return duplicate_groups(kept, property_columns(kept))


def feature_report(df: DataFrame) -> dict[str, DataFrame]:
    return stats.feature_tables(df)


def model_analysis(df: DataFrame, kind: str, model: str = "ols", folds: int = 5, spec: Spec | None = None) -> dict[str, DataFrame]:
    """Estimates with errors beside the rows they belong to, scores by fold, and roll-ups by time."""
    matrix: DesignMatrix = design_matrix(df, kind, **({"spec": spec} if spec is not None else {}))
    estimates, scores = models.cross_validate(matrix.table, matrix.columns, matrix.y, models.MODELS[model], folds)
    table = models.estimation_table(estimates)
    beside = full_extend(table, df)
    error = F.col("cv_errors")
    return {
        "estimates": beside,
        "scores": scores,
        "describe": stats.describe(table, "cv_errors"),
        "density": stats.kernel_density(table.where("cv_estimates > 0"), "cv_errors"),
        "daily": stats.mean_error_by(beside.where("cv_errors is not null"), "last_encounted", error, "day"),
        "weekly": stats.mean_error_by(beside.where("cv_errors is not null"), "last_encounted", error, "week"),
        "monthly": stats.mean_error_by(beside.where("cv_errors is not null"), "last_encounted", error, "month"),
    }


def comparison_estimates(df: DataFrame, kind: str, comparisons: Sequence, spec: Spec, model: str = "ols") -> DataFrame:
    """Estimates for a set of made-up properties from a model fitted on the data."""
    matrix = design_matrix(df, kind, spec)
    fitted = models.MODELS[model](models.assembled(matrix.table, matrix.columns), "features", matrix.y)
    rows = combinations(df.sparkSession, comparisons)
    estimated = fitted.transform(models.assembled(encode_like(rows, matrix.columns), matrix.columns))
    return rows.join(estimated.select("row_id", F.col("prediction").alias("estimate")), "row_id")
