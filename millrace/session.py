"""Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, app: str = "millrace", **settings: str) -> SparkSession:
    """The session of ``master`` (default: what spark-submit says); later settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
