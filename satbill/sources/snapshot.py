"""Written intermediate tables: lineage ends there, and an executor's loss does not undo them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def snapshot_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only for a local session without one."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="satbill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(SETTING, folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder to be written; ``remove_snapshots`` deletes it."""
    path = f"{snapshot_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files behind: nothing reads them again, but they would stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def snapshot(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Later steps prune its columns and see its true size, which a recomputed subplan cannot offer.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_snapshots(spark: SparkSession) -> int:
    """Delete the tables this process has written here. Call it when no result that reads them is needed any more."""
    removed = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
