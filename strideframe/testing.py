"""A small local session for tests and checks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("strideframe")
             .config("spark.sql.shuffle.partitions", str(cores))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
