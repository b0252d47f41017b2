"""The session that the library is written for; any other session with these settings will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "sextant", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; keyword arguments (dots as __) override settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.pythonUDF.arrow.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
