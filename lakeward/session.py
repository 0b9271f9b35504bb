"""Session factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lakeward", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow transfer. ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
