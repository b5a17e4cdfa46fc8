"""Spark session settings the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def local_session(cores: int | str = 8, app: str = "shelfsight", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {**SETTINGS, **LOCAL_SETTINGS, "spark.sql.shuffle.partitions": "8", **extra}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bench_cores() -> str:
    return os.environ.get("BENCH_CPUS", "8")
