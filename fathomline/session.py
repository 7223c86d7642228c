"""Session settings shared by tests, the bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fathomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans expect; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
