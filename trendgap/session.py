"""A session for tests, checks and benchmarks on one machine.

Cluster jobs bring their own session; nothing else in the package creates one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str, cores: str = "8", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
