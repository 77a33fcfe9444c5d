"""Session factory: UTC, adaptive execution, and partition sizes that follow the data."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings all operators assume; ``conf`` uses ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
