"""Continuous ingestion that knows what every file held before: repeated, changed and torn deliveries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from satbill.sources.files import raw_lines
from satbill.sources.loads import log_load
from satbill.streaming.ingest import load_batch

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOADS = ("NEW", "CHANGED", "RELEASED")
PARTS = "name string, file_path string, modified timestamp, size long, first long, second long, lines long, bytes long"
ACTIONS = "name string, file_path string, nth int, action string"
STATE = "first long, second long, lines long, waiting string, wait_first long, wait_second long, wait_lines long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file and batch of lines, whatever the number of lines."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        # sums of hashes wrap around, which Arrow's own sum does as well
        yield from table.group_by(["name", "file_path", "modified", "size"]).aggregate(
            [("first", "sum"), ("second", "sum"), ("bytes", "count"), ("bytes", "sum")]
        ).rename_columns(["name", "file_path", "modified", "size", "first", "second", "lines", "bytes"]).to_batches()


def digests(lines: DataFrame) -> DataFrame:
    """Parts of each file's digest (``PARTS``), to be added up per file.

    ``lines``: value, name, file_path, modified, size; the value still has its carriage return. The digest is the number of
    lines and two sums of 64-bit hashes over them, so it depends on what lines there are and not on how the file is split;
    a file with its lines in another order holds the same records and has the same digest.
    """
    hashed = lines.select(
        "name", "file_path", "modified", "size", F.xxhash64("value").alias("first"), F.xxhash64(F.lit(1), "value").alias("second"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
    )
    return hashed.mapInArrow(_sums, PARTS)


def _versions(parts: Iterator[pd.DataFrame]) -> list[tuple]:
    """(modified, path, digest, whole) of each version of a file, oldest first."""
    found: dict[str, list] = {}
    for frame in parts:
        for path, modified, size, *counts in frame[["file_path", "modified", "size", "first", "second", "lines", "bytes"]].itertuples(index=False):
            kept = found.setdefault(path, [modified, size, np.zeros(4, np.int64)])
            kept[2] = kept[2] + np.array(counts, np.int64)
    versions = []
    for path, (modified, size, (first, second, lines, read)) in found.items():
        # every line counted with a line break: one byte too many if the last has none; a byte order mark is not read
        versions.append((modified, path, (int(first), int(second), int(lines)), read - size in (0, -3)))
    return sorted(versions)


def _decide(patience: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, path, held = None, None, (0, 0, 0)
        if state.exists:
            now = state.get
            known, path, held = (tuple(now[:3]) if now[2] >= 0 else None), now[3], tuple(now[4:])
        made: list[tuple[str, str]] = []
        if state.hasTimedOut:
            made, known, path = [(path, "RELEASED")] if path else [], held if path else known, None
        else:
            for _, file_path, digest, whole in _versions(parts):
                if digest == known:
                    path = None
                    made.append((file_path, "UNCHANGED"))
                elif whole:
                    made.append((file_path, "CHANGED" if known else "NEW"))
                    known, path = digest, None
                else:
                    made.append((file_path, "WAITING"))
                    path, held = file_path, digest
        state.update((*(known or (0, 0, -1)), path, *held))
        if path:
            state.setTimeoutDuration(patience)
        rows = [(key[0], at, i, action) for i, (at, action) in enumerate(made)]
        yield pd.DataFrame(rows, columns=["name", "file_path", "nth", "action"]).astype({"nth": "int32"})

    return step


def _carry_out(actions: DataFrame, batch: int, table_path: str, log_path: str, actions_path: str, kind: str) -> None:
    """Load what one batch decided; what it decided is written first, so that it is computed once."""
    spark = actions.sparkSession
    log_load(actions.select("name", "file_path", "nth", "action"), actions_path, batch)
    done = read_actions(spark, actions_path).filter(F.col("batch") == str(batch))
    newest = Window.partitionBy("name").orderBy(F.desc("nth"))
    chosen = done.filter(F.col("action").isin(*LOADS)).withColumn("_at", F.row_number().over(newest)).filter("_at = 1")
    # at most as many paths as files fit in a batch, and the timers that went off
    paths = {row.file_path: row.name for row in chosen.select("file_path", F.col("name")).toLocalIterator()}
    if paths:
        named = spark.createDataFrame([(k, v) for k, v in paths.items()], "file_path string, name string")
        lines = raw_lines(spark, list(paths)).join(F.broadcast(named), "file_path")
        load_batch(lines.withColumn("source_file", F.col("name")).drop("name"), table_path, log_path, batch, kind)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """What was decided about every delivery: name, file_path, nth, action, batch."""
    return spark.read.schema(ACTIONS + ", batch string").parquet(path)


def stream_deliveries(
    spark: SparkSession, src: str, table_path: str, log_path: str, actions_path: str, checkpoint: str, kind: str = "usage",
    naming: Callable[[Column], Column] | None = None, patience: int = 3_600_000, files_per_batch: int = 1000, every: str | None = None,
) -> StreamingQuery:
    """Load the files of a folder and those below it; a later file of the same name is a new delivery of that file.

    The state of a name is the digest of what was loaded. A delivery with the same lines is UNCHANGED and not loaded again;
    any other one replaces the file's rows (NEW, CHANGED). A file whose last line has no line break may still be under way:
    it is WAITING, and RELEASED to be loaded as it is if ``patience`` milliseconds pass without another delivery. Of
    several versions in one batch the newest is loaded, by time, then path. Names compare without case; ``naming``
    derives them from the path (default: its last part). Files without a single line are not seen.

    Lines are hashed and summed where they are read; a row per file and batch of lines meets the state. ``every`` is a
    trigger interval; without it, what is there is taken and the stream stops, and timers go off in a later run that meets
    new files.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n").option("recursiveFileLookup", True).load(src)
    path = F.col("_metadata.file_path")
    name = naming(path) if naming else F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    lines = lines.select(
        "value", F.upper(name).alias("name"), path.alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"),
    )
    actions = digests(lines).groupBy("name").applyInPandasWithState(
        _decide(patience), ACTIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    writer = actions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: _carry_out(df, batch, table_path, log_path, actions_path, kind)
    )
    if every:
        return writer.trigger(processingTime=every).start()
    # timers ask for a batch after each batch; a stream that is to stop must not go on for them
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
