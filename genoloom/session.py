"""Session helper for local runs; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session on this machine, with the settings the engine's tests and bench use."""
    base = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": "genoloom",
        "spark.sql.shuffle.partitions": str(os.environ.get("GENOLOOM_SHUFFLE", 8)),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("GENOLOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
