"""Load bookkeeping: idempotent appends, load log, completeness, history."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satbill.functions.sem import nz

LOG_SCHEMA = (
    "table_name string, file_name string, records_loaded long, load_status string, "
    "started timestamp, finished timestamp, seconds double, error_message string"
)
STATUSES = ("SUCCESS", "FAILED", "PARTIAL")


def replace_by_source(target: DataFrame, batch: DataFrame) -> DataFrame:
    """``target`` without the rows of the batch's files (names compare without case), plus the batch."""
    files = batch.select(F.upper("source_file").alias("_file")).distinct()
    kept = target.join(files, F.upper("source_file") == F.col("_file"), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def write_replacing(batch: DataFrame, path: str) -> None:
    """The same on disk: one partition per file, and only the batch's partitions are rewritten.

    Writing a batch again gives the same table, so a lost or repeated attempt does no harm.
    """
    (
        batch.withColumn("source_key", F.upper("source_file"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)
    )


INSERT_KEY = ["contract_id", "imei", "bill_month", "service", "usage_type", "source_file"]


def insert_new(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows to insert: new by key, once each.

    The byte count compares NULL-safe; a NULL in any other key part matches nothing, so such rows
    are all kept. Copies fold by aggregation before the anti join.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in INSERT_KEY])
    keys = [*INSERT_KEY, "usage_bytes"]
    rest = [n for n in batch.columns if n not in keys]
    single = batch.filter(complete).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r") if rest else F.count(F.lit(1)).alias("_r"))
    known = target.filter(complete).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k) == F.col(f"_{k}") for k in INSERT_KEY] + [F.col("usage_bytes").eqNullSafe(F.col("_usage_bytes"))]
    fresh = single.join(known, on, "left_anti").select(
        *[F.col(f"_r.{n}") if n in rest else F.col(n) for n in batch.columns]
    )
    return fresh.unionByName(batch.filter(~complete))


def log_entries(
    loaded: DataFrame, table_name: str, started: dt.datetime, finished: dt.datetime,
    status: str = "SUCCESS", error: str | None = None,
) -> DataFrame:
    """Log rows for loaded files, one per file with its accepted row count."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return loaded.groupBy(F.col("source_file").alias("file_name")).agg(F.count(F.lit(1)).alias("records_loaded")).select(
        F.lit(table_name).alias("table_name"), "file_name", "records_loaded", F.lit(status).alias("load_status"),
        F.lit(started).cast("timestamp").alias("started"), F.lit(finished).cast("timestamp").alias("finished"),
        F.lit((finished - started).total_seconds()).alias("seconds"), F.lit(error).cast("string").alias("error_message"),
    )


def file_log_entries(
    files: DataFrame, loaded: DataFrame, table_name: str, started: dt.datetime, finished: dt.datetime
) -> DataFrame:
    """A log row for every delivered file (``file_records``), loaded or not.

    FAILED without a header, PARTIAL where fewer rows were taken than the file has data lines, else SUCCESS. ``loaded``
    has a row per line taken, those that are left out on purpose included.
    """
    counts = loaded.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    status = F.when(~F.col("has_header"), F.lit("FAILED")).when(nz("_n") < F.col("records_in_file"), F.lit("PARTIAL")).otherwise(F.lit("SUCCESS"))
    error = F.when(~F.col("has_header"), F.lit("no line carries the expected headings")).when(
        nz("_n") < F.col("records_in_file"), F.format_string("%d of %d records taken", nz("_n"), F.col("records_in_file"))
    )
    return files.join(counts, "source_file", "left").select(
        F.lit(table_name).alias("table_name"), F.col("source_file").alias("file_name"), nz("_n").cast("long").alias("records_loaded"),
        status.alias("load_status"), F.lit(started).cast("timestamp").alias("started"), F.lit(finished).cast("timestamp").alias("finished"),
        F.lit((finished - started).total_seconds()).alias("seconds"), error.alias("error_message"),
    )


def log_load(entries: DataFrame, path: str, batch: str | int) -> None:
    """Append log rows; the batch's own partition is rewritten, so a repeated batch logs once."""
    (
        entries.withColumn("batch", F.lit(str(batch)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA + ", batch string").parquet(path)


def _facts(files: DataFrame, log: DataFrame, table: DataFrame, table_name: str) -> DataFrame:
    """Files with what the log and the table know of them; names compare without case."""
    good = (
        log.filter((F.upper("table_name") == table_name.upper()) & (F.col("load_status") == "SUCCESS"))
        .groupBy(F.upper("file_name").alias("_f")).agg(F.max("records_loaded").alias("records_logged"))
        .withColumn("_logged", F.lit(True))
    )
    stored = table.groupBy(F.upper("source_file").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        files.withColumn("_f", F.upper("file_name"))
        .join(good, "_f", "left").join(stored, "_f", "left")
        .withColumn("records_in_table", nz("_n"))
        .withColumn("has_log", F.coalesce("_logged", F.lit(False)))
        .drop("_f", "_n", "_logged")
    )


def load_status(
    files: DataFrame, log: DataFrame, table: DataFrame, table_name: str, against: str = "file"
) -> DataFrame:
    """Whether each file (file_name, records_in_file) is fully loaded.

    ``against="file"`` wants as many rows as the file has, ``"log"`` as many as the load accepted.
    """
    facts = _facts(files, log, table, table_name)
    wanted = F.col("records_in_file") if against == "file" else F.col("records_logged")
    done = F.col("has_log") & (F.col("records_in_table") > 0) & (
        (nz(wanted) == 0) | (F.col("records_in_table") >= nz(wanted))
    )
    return facts.select("file_name", "records_in_file", "records_in_table", "has_log", done.alias("is_loaded"))


def triage_files(files: DataFrame, log: DataFrame, table: DataFrame, table_name: str) -> DataFrame:
    """What to do with each file: loaded, reload (partly stored), orphaned log, or new."""
    stored, expected = F.col("records_in_table"), nz("records_in_file")
    label = (
        F.when(F.col("has_log") & (stored > 0) & (expected > 0) & (stored < expected), F.lit("RELOAD"))
        .when(F.col("has_log") & (stored > 0), F.lit("LOADED"))
        .when(F.col("has_log"), F.lit("ORPHANED_LOG"))
        .otherwise(F.lit("NEW"))
    )
    return _facts(files, log, table, table_name).select("file_name", "records_in_file", "records_in_table", label.alias("triage"))


def rebuild_history(table: DataFrame) -> DataFrame:
    return table.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("records_count"),
        F.min("load_date").alias("first_load"),
        F.max("load_date").alias("last_load"),
    )


def missing_logs(table: DataFrame, log: DataFrame, table_name: str) -> DataFrame:
    """Files in the table without a successful log entry; rows fold to files before the anti join."""
    good = log.filter((F.upper("table_name") == table_name.upper()) & (F.col("load_status") == "SUCCESS")).select(
        F.upper("file_name").alias("_f")
    )
    per_file = table.filter(F.col("source_file").isNotNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("records_count"))
    return per_file.join(good, F.upper("source_file") == F.col("_f"), "left_anti")


def latest_files(table: DataFrame, n: int = 20) -> DataFrame:
    return (
        table.filter(F.col("source_file").isNotNull()).groupBy("source_file")
        .agg(F.max("load_date").alias("last_load"), F.count(F.lit(1)).alias("records_count"))
        .orderBy(F.col("last_load").desc(), "source_file").limit(n)
    )


def load_stats(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("imei").alias("devices"),
        nz(F.sum("usage_bytes")).alias("total_bytes"), nz(F.sum("total_amount")).alias("total_amount"),
    )


def census(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, distinct periods and first and last period of several tables, stacked."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"), F.count_distinct(col).alias("periods"),
            F.min(col).cast("string").alias("first_period"), F.max(col).cast("string").alias("last_period"),
        ).select(F.lit(name).alias("table_name"), "row_count", "periods", "first_period", "last_period")
        for name, (df, col) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
