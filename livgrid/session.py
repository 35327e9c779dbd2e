"""Session helper used by the bench and by tests; a cluster passes its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "livgrid", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; `conf` overrides any of them."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": name,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.local.dir": os.environ.get("SPARK_LOCAL_DIRS", "/tmp/livgrid-local"),
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
