"""Spark session for the engine: UTC, adaptive execution, ANSI errors, last duplicate map key wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Address components: of repeated labels the later one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "parcelmill", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
