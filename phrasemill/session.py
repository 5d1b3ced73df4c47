"""Spark session with the settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "phrasemill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
