"""Size of the record batches that Python tasks get."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Batches of ``ROWS`` rows: whole texts are long, and a batch is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
