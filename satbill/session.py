"""Session settings the library relies on, applied at run time."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Run-time SQL settings only; cluster sizing (executors, memory, shuffle width) stays with the caller.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A third of all rows may share one key: split such join partitions even when
    # that costs an extra shuffle further down.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made by someone else."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "satbill", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # fewer calls per column while building plans
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/satbill-warehouse")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)

