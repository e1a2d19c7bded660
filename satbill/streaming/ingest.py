"""Continuous ingestion of supplier files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from satbill.sources.files import FEE_MUST, USAGE_MUST, fee_rows, file_facts, file_records, raw_lines, usage_rows
from satbill.sources.loads import file_log_entries, log_load, write_replacing
from satbill.sources.snapshot import snapshot

PARSERS = {"usage": (usage_rows, USAGE_MUST), "fees": (fee_rows, FEE_MUST)}


def load_batch(lines: DataFrame, table_path: str, log_path: str, batch: str | int, kind: str = "usage") -> None:
    """Store one batch of lines and log each of its files, those that could not be read included.

    Lines of the left-out line of business count as taken, but are not stored. The table keeps one partition per file and the log one per batch, both rewritten whole:
    running a batch twice leaves the same result as running it once.
    """
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    parse, must_have = PARSERS[kind]
    facts = snapshot(file_facts(lines, must_have), "file-facts")  # parsing and logging both read them
    kept = snapshot(parse(lines, facts=facts).withColumn("load_date", F.lit(started).cast("timestamp")), f"ingest-{kind}")
    stored = kept if kind == "usage" else kept.filter(~F.coalesce(F.upper(F.trim("service")) == "BROADBAND", F.lit(False)))
    write_replacing(stored, table_path)
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    log_load(file_log_entries(file_records(lines, must_have, facts), kept, kind, started, finished), log_path, batch)


def stream_ingest(
    spark: SparkSession, src: str, table_path: str, log_path: str, checkpoint: str, kind: str = "usage",
    files_per_batch: int = 1000, once: bool = True,
) -> StreamingQuery:
    """Load every new file of a folder; the checkpoint remembers which files were seen.

    A file always arrives whole in one micro-batch. ``once`` takes what is there and stops.
    """
    lines = raw_lines(spark, src, stream=True, files_per_batch=files_per_batch)
    writer = (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch: load_batch(df, table_path, log_path, batch, kind))
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()

