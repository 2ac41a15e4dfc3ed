"""Session defaults for tests, the bench and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "portcullis", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution on, a few shuffle partitions.

    A cluster brings its own session; nothing in the library depends on this one.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
