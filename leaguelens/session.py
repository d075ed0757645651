"""Session construction with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "leaguelens", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the platform's own session instead."""
    n = cores or 8
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
