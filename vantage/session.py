"""A session with the settings that the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **settings: str) -> SparkSession:
    build = SparkSession.builder.master(master).appName("vantage")
    options = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    for key, value in (options | {k.replace("__", "."): v for k, v in settings.items()}).items():
        build = build.config(key, value)
    return build.getOrCreate()
