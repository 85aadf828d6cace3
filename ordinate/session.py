"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """The session of a master (that of spark-submit without one); more overrides settings, with _ for dots."""
    builder = SparkSession.builder.appName("ordinate").config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
