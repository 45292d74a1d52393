"""Spark session with the settings that the library expects."""
from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", app: str = "lectern", **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE and Arrow; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
