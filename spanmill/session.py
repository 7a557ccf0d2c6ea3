"""Session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "spanmill", **settings: str) -> SparkSession:
    """Adaptive execution splits skewed joins and joins small partitions; ANSI mode stays
    on, so operators guard division and casts themselves."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
