"""Session factory with the settings every query assumes (UTC, AQE, ANSI left on)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", app: str = "lodestrata", **conf: str) -> SparkSession:
    """Return a session; ``conf`` keys use underscores for dots (``spark_sql_x`` = ``spark.sql.x``)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
