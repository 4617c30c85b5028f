"""Session settings the library is tuned for.

Nothing in the library creates a session by itself: every function takes a
DataFrame or the caller's session. These builders serve tests and the bench.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution carries the skew handling of the fact-to-feature joins
# (they are left joins whose large side is split at run time), so it is stated
# here although it is Spark's default.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | None = None, app: str = "pitlog", **extra: str) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for cut lineage, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)
